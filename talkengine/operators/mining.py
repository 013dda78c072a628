"""Mining positives and negatives from transcripts, and putting the mined rows into the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from .relate import keep_first, net_new, numbered

_LINE = r"^(?:\[(\d{1,2}:\d{2}:\d{2})\]\s*)?([A-Z]\w{0,7}):\s+(.*)$"


def lines(documents: DataFrame, id_: str, text: str) -> DataFrame:
    """(doc_id, line_no, line): the lines of whole texts, numbered from 1."""
    parts = documents.where(F.col(text).isNotNull()).select(F.col(id_).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return parts.select("doc_id", (F.col("line_no") + 1).alias("line_no"), "line")


def turns(documents: DataFrame, id_: str, text: str) -> DataFrame:
    """(doc_id, line_no, clock, speaker, utterance): the lines of the form [hh:mm:ss] speaker: utterance."""
    rows = lines(documents, id_, text).where(F.col("line").rlike(_LINE))
    clock = F.regexp_extract("line", _LINE, 1)
    return rows.select("doc_id", "line_no", F.when(clock != "", clock).alias("clock"), F.regexp_extract("line", _LINE, 2).alias("speaker"), T.strip(F.regexp_extract("line", _LINE, 3)).alias("utterance"))


def teacher_negatives(rows: DataFrame, speaker: str, text: str, code: str, behaviour: str) -> DataFrame:
    """Teacher turns without a science code, with transcript_subtype by the behaviour code."""
    kept = rows.where(T.is_teacher(speaker) & ~T.is_science_code(code) & (F.coalesce(T.strip(text), F.lit("")) != ""))
    flagged = F.upper(T.strip(behaviour)) == "Y"
    return kept.withColumn("transcript_subtype", F.when(flagged, "behavior_disapproving").otherwise("other_teacher_talk"))


def teacher_positives(rows: DataFrame, speaker: str, text: str, code: str) -> DataFrame:
    """The complement: teacher turns with a science code."""
    return rows.where(T.is_teacher(speaker) & T.is_science_code(code) & (F.coalesce(T.strip(text), F.lit("")) != ""))


def without_tokens(rows: DataFrame, text: str, tokens: DataFrame, token: str, chunk: int = 20_000) -> DataFrame:
    """Rows whose text holds none of the tokens as a substring; the vocabulary travels as arrays of about ``chunk`` tokens,
    one more pass over the rows in the same stage for each."""
    words = tokens.where(F.coalesce(F.col(token), F.lit("")) != "").select(F.lower(token).alias("_t")).distinct()
    chunks = max(1, -(-words.count() // chunk))
    out = rows.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    for n in range(chunks):
        some = words.where(F.pmod(F.xxhash64("_t"), F.lit(chunks)) == n).agg(F.collect_list("_t").alias("_tokens"))  # one row
        out = out.crossJoin(F.broadcast(some)).where(~F.exists("_tokens", lambda t: F.col("_low").contains(t))).drop("_tokens")
    return out.drop("_low")


def capped(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each file."""
    from pyspark.sql import Window as W

    return rows.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def distinct_utterances(rows: DataFrame, text: str, order: list[str]) -> DataFrame:
    """The first row per canonical text; empty texts drop."""
    return keep_first(rows.withColumn("_canon", T.canon(text)).where("_canon <> ''"), ["_canon"], order).drop("_canon")


def mined(rows: DataFrame, text: str, order: list[str], corpus: DataFrame, corpus_text: str) -> DataFrame:
    """Fragments dropped, first of equal texts kept, texts of the corpus dropped."""
    whole = rows.where(~T.is_fragment(text))
    return net_new(distinct_utterances(whole, text, order), corpus, T.canon(text), T.canon(corpus_text))


def as_corpus(rows: DataFrame, text: str, sheet: str, order: list[str], start: int, source: str = "y1_transcript_sci") -> DataFrame:
    """Mined rows in the corpus schema with ids that go on from ``start``."""
    out = numbered(rows, order, "utt_id", "utt_sci_%04d", start)
    empty = F.array().cast("array<string>")
    return out.select("utt_id", F.col(text).alias("utterance"), F.lit("SCIENCE_TALK").alias("label"), T.sheet_setting(sheet).alias("setting"), F.lit(source).alias("source"),
                      empty.alias("tier2_cues"), empty.alias("tier3_cues"), F.lit(1).alias("was_sci_coded"))


def counts_by_sheet(rows: DataFrame, sheet: str, speaker: str, code: str) -> DataFrame:
    """(sheet, n, science, science_teacher)."""
    sci = T.is_science_code(code)
    return rows.groupBy(F.col(sheet).alias("sheet")).agg(F.count("*").alias("n"), F.count_if(sci).alias("science"), F.count_if(sci & T.is_teacher(speaker)).alias("science_teacher"))


def leak_free(negatives: DataFrame, text: str, positives: DataFrame, positive_text: str) -> DataFrame:
    """Negatives whose trimmed lower-case text is no positive's."""
    key = lambda c: F.lower(T.strip(c))
    return net_new(negatives, positives, key(text), key(positive_text))


def pool(parts: list[tuple[int, DataFrame]], text: str, order: str, positives: DataFrame, positive_text: str, seed: Column | None = None) -> DataFrame:
    """Sources united, malformed texts dropped, equal texts kept once by source precedence, leaks dropped."""
    rows = None
    for precedence, part in parts:
        p = part.withColumn("_source", F.lit(precedence))
        rows = p if rows is None else rows.unionByName(p, allowMissingColumns=True)
    ok = rows.where(T.well_formed(text, seed))
    once = keep_first(ok.withColumn("_t", T.strip(text)), ["_t"], ["_source", order]).drop("_t", "_source")
    return leak_free(once, text, positives, positive_text)
