"""Text scalars. All but ``nfkc`` and ``casefolded`` stay inside whole-stage code generation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# The closed vocabularies of the data model.
SETTINGS = ("Large Group", "Small Group", "Centers", "Transition", "Conversation", "Blocks/Engineering", "Unknown")
INFORMAL_SETTINGS = ("Centers", "Transition", "Conversation", "Blocks/Engineering")
REGISTERS = ("LARGE_GROUP", "SMALL_GROUP", "INFORMAL")
SETTING_REGISTER = {"Large Group": "LARGE_GROUP", "Small Group": "SMALL_GROUP", "Centers": "INFORMAL", "Blocks/Engineering": "INFORMAL"}
SHEET_SETTING = {"LG": "Large Group", "SG": "Small Group", "C": "Centers"}
NULL_WORDS = ("", "nan", "<NA>", "None")
TEACHER = r"^T\d*:?$"
#: A word: letters, digits and underscores of any script.
WORD, NO_WORD = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_]+"


def squeeze(c: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"^\s+|\s+$", "")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """NFKC, white space squeezed; null stays null. The one text scalar without a built-in counterpart."""
    return s.map(lambda t: None if t is None else " ".join((t if t.isascii() else unicodedata.normalize("NFKC", t)).split()))


@F.pandas_udf(StringType())
def casefolded(s: pd.Series) -> pd.Series:
    """NFKC, squeezed, case-folded; null becomes ''."""
    return s.map(lambda t: "" if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold())


def canon(c: Column | str) -> Column:
    """The form in which two texts are the same: NFKC, squeezed, case-folded; null as ''. One Arrow pass, so callers
    compute it once per row and compare the result."""
    return casefolded(F.col(c) if isinstance(c, str) else c)


def blank_to_null(c: Column | str, words: tuple[str, ...] = NULL_WORDS) -> Column:
    s = strip(c)
    return F.when(~s.isin(*words), s)


def routing_label(c: Column | str) -> Column:
    """auto, spot, review ... in lower case; '', 'nan' and '<na>' are null."""
    s = F.lower(strip(c))
    return F.when(~s.isin("", "nan", "<na>"), s)


def cue_list(c: Column | str) -> Column:
    """The trimmed, non-empty parts between | , and ; as an array; [] for null."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.filter(F.transform(F.split(c, r"[|,;]"), strip), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def setting_of(c: Column | str) -> Column:
    """The part before ' / ' if it is a known setting, else Unknown."""
    c = F.col(c) if isinstance(c, str) else c
    head = strip(F.element_at(F.split(c, " / "), 1))
    return F.when(head.isin(*SETTINGS), head).otherwise("Unknown")


def topic_of(c: Column | str) -> Column:
    """What follows the first ' / ', else null."""
    c = F.col(c) if isinstance(c, str) else c
    rest = strip(F.array_join(F.slice(F.split(c, " / "), 2, 1000), " / "))
    return F.when(rest != "", rest)


def transcript_ref(c: Column | str) -> Column:
    """The first '(sheet #number' of a note."""
    c = F.col(c) if isinstance(c, str) else c
    found = strip(F.regexp_extract(c, r"\(([^,)]+#\d+)", 1))
    return F.when(found != "", found)


def mentions_coding(c: Column | str) -> Column:
    """1 if a note says SCI-coded in any letter case, else 0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.lower(c).contains("sci-coded"), F.lit(False)).cast("int")


def sheet_of(ref: Column | str) -> Column:
    """The sheet of a reference such as 01-2_19LG!R45 or '01-2_19LG #45'."""
    ref = F.col(ref) if isinstance(ref, str) else ref
    sheet = F.regexp_extract(ref, r"^([^!#]+?)\s*[!#]", 1)
    return F.when(sheet != "", sheet)


def row_of(ref: Column | str) -> Column:
    ref = F.col(ref) if isinstance(ref, str) else ref
    return F.regexp_extract(ref, r"[!#]R?(\d+)$", 1).try_cast("int")


def sheet_setting(sheet: Column | str) -> Column:
    """The setting that the trailing letters of a sheet name stand for."""
    sheet = F.col(sheet) if isinstance(sheet, str) else sheet
    suffix = F.upper(F.regexp_extract(sheet, r"([A-Za-z]+)\d*$", 1))
    return F.coalesce(_lookup(SHEET_SETTING, suffix), F.lit("Unknown"))


def register_of(setting: Column | str) -> Column:
    return _lookup(SETTING_REGISTER, strip(setting))


def _lookup(table: dict[str, str], key: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def spoken(cell: Column | str) -> Column:
    """A transcript cell without its trailing (NN.N%)."""
    cell = F.col(cell) if isinstance(cell, str) else cell
    return strip(F.regexp_replace(cell, r"\s*\(\d+(?:\.\d+)?%\)\s*$", ""))


def confidence_of(cell: Column | str) -> Column:
    """The trailing (NN.N%) of a transcript cell as a share, null if there is none."""
    cell = F.col(cell) if isinstance(cell, str) else cell
    return F.regexp_extract(cell, r"\((\d+(?:\.\d+)?)%\)\s*$", 1).try_cast("double") / 100


def child_of(file: Column | str) -> Column:
    """The fourth dash-separated part of a file name before its first underscore, else base."""
    file = F.col(file) if isinstance(file, str) else file
    parts = F.split(F.element_at(F.split(file, "_"), 1), "-")
    return F.when(F.size(parts) >= 4, F.get(parts, F.lit(3))).otherwise("base")


def unique_sheet_names(df, child: str, within: list[str], out: str = "sheet"):
    """Adds the sheet name of each row, with _1, _2 ... where several children of a workbook get the same one."""
    from pyspark.sql import Window as W

    rows = df.withColumn("_base", sheet_name(child))
    k = F.row_number().over(W.partitionBy(*within, "_base").orderBy(child)) - 1  # the children of one workbook
    mark = F.concat(F.lit("_"), k.cast("string"))
    return rows.withColumn(out, F.when(k == 0, F.col("_base")).otherwise(F.concat(F.expr("substring(_base, 1, 31)").substr(F.lit(1), F.lit(31) - F.length(mark)), mark))).drop("_base")


def sheet_name(child: Column | str) -> Column:
    """A legal sheet name: no []:*?/\\ and at most 31 characters."""
    child = F.col(child) if isinstance(child, str) else child
    return F.substring(F.regexp_replace(child, r"[\[\]:*?/\\]", ""), 1, 31)


def word_count(c: Column | str) -> Column:
    """Runs of letters, digits and underscores of any script."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_count(c, F.lit(WORD))


def token_count(c: Column | str) -> Column:
    """Tokens between white space."""
    s = strip(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"\s+")))


def is_fragment(c: Column | str, min_words: int = 5, min_chars: int = 20) -> Column:
    s = F.coalesce(strip(c), F.lit(""))
    return (F.length(s) < min_chars) | (word_count(s) < min_words)


def padded_words(c: Column | str) -> Column:
    """The words in lower case between single blanks, with a blank at both ends, for whole-word ``contains`` tests."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), NO_WORD, " ")), F.lit(" "))


def has_term(c: Column | str, term: Column | str) -> Column:
    """Whether the text holds the term, signs included, with no word going on at either end, in any letter case."""
    low, t = (F.lower(F.col(x) if isinstance(x, str) else x) for x in (c, term))
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{N}_])"))
    return F.when(low.contains(t), F.regexp_like(low, quoted)).otherwise(F.when(low.isNotNull() & t.isNotNull(), False))


def well_formed(c: Column | str, seed: Column | str | None = None, low: int = 2, high: int = 40) -> Column:
    """low to high white-space tokens, and the seed term, if there is one, as whole words."""
    tokens = token_count(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    ok = (tokens >= low) & (tokens <= high)
    if seed is None:
        return ok
    seed = F.col(seed) if isinstance(seed, str) else seed
    return ok & (seed.isNull() | F.coalesce(has_term(c, seed), F.lit(False)))


def plain(c: Column | str) -> Column:
    """Squeezed lower case, null as ''; a built-in expression."""
    return F.coalesce(F.lower(squeeze(c)), F.lit(""))


def differs(variant: Column | str, anchor: Column | str) -> Column:
    """The variant says something, and not the anchor in other letter case or spacing."""
    v = plain(variant)
    return (v != "") & (v != plain(anchor))


def is_teacher(speaker: Column | str) -> Column:
    return strip(speaker).rlike(TEACHER)


def is_science_code(code: Column | str) -> Column:
    code = F.col(code) if isinstance(code, str) else code
    return F.coalesce(F.upper(code).contains("SCI"), F.lit(False))


def embedding_text(c: Column | str) -> Column:
    return F.coalesce(strip(c), F.lit(""))
