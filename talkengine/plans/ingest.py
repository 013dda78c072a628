"""From files to tables: the three sheets of the curated workbook, coded transcripts, text transcripts, folders of recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import mining
from ..sources.files import transcript_lines

# The sheets of the curated workbook and the columns that are read of each.
SHEETS = {"corpus": "Example utterances", "seed_words": "Seed words", "category_defs": "Category definitions"}
CORPUS_COLUMNS = {"utterance": "Utterance", "label": "Label", "setting": "Setting", "source": "Source", "tier2": "Tier2 cues", "tier3": "Tier3 cues", "notes": "Notes", "citation": "Article citation"}
SEED_COLUMNS = {"term": "Term", "tier": "Tier", "category": "Category", "variants": "Variants (optional)", "curriculum_source": "Curriculum_source", "source_url": "Source_URL"}
DEF_COLUMNS = {"label": "Label", "type": "Type", "definition": "Definition (operational)", "include_if": "Include if…", "exclude_if": "Exclude if…", "examples": "Examples (teacher wording)"}
# Sheets of coded workbooks that hold no transcript, and the places of the columns that are read of the others.
META_SHEETS = ("TOC", "Sheet1", "Sheet5", "Coding Scheme")
CODED = {"speaker": 2, "utterance": 3, "behaviour": 4, "code": 6}


def workbook(spark: SparkSession, path: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """(sheet, row_no, cells) of one or more workbooks."""
    from ..sources.xlsx import XlsxSource

    spark.dataSource.register(XlsxSource)
    return spark.read.format("xlsx").option("skip_sheets", ",".join(skip)).load(path)


def sheet(cells: DataFrame, name: str, columns: dict[str, str]) -> DataFrame:
    """(row_no, columns) of a sheet whose first row names its columns; a column that is not there raises."""
    rows = cells.where(F.col("sheet") == name)
    heading = rows.where("row_no = 1").select("cells").first()
    titles = [(c or "").strip() for c in heading["cells"]] if heading else []
    if absent := [t for t in columns.values() if t not in titles]:
        raise ValueError(f"sheet {name} lacks {absent}")
    body = rows.where("row_no > 1").select("row_no", *[F.get("cells", F.lit(titles.index(t))).alias(c) for c, t in columns.items()])
    return body.where(" or ".join(f"{c} is not null" for c in columns))


def seed_words(raw: DataFrame) -> DataFrame:
    """Seed rows with the term normalised and the variants as an array."""
    return raw.select(T.nfkc("term").alias("term"), "tier", "category", T.cue_list("variants").alias("variants"), "curriculum_source", "source_url")


def curated(spark: SparkSession, path: str, sheets: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The raw corpus rows (for ``jobs.clean``), the seed words and the category definitions of the curated workbook."""
    cells, names = workbook(spark, path), SHEETS | (sheets or {})
    return {
        "corpus": sheet(cells, names["corpus"], CORPUS_COLUMNS),
        "seed_words": seed_words(sheet(cells, names["seed_words"], SEED_COLUMNS)),
        "category_defs": sheet(cells, names["category_defs"], DEF_COLUMNS).drop("row_no"),
    }


def coded_turns(spark: SparkSession, path: str, skip: tuple[str, ...] = META_SHEETS) -> DataFrame:
    """(sheet, row_no, speaker, utterance, behaviour, code) of coded workbooks, below the heading of each sheet."""
    from ..sources.xlsx import named

    return named(workbook(spark, path, skip), CODED)


def coded_negatives(turns: DataFrame, seeds: DataFrame | None = None, max_total: int | None = None) -> DataFrame:
    """Teacher turns without a science code as (text, transcript_subtype, transcript_code, transcript_ref), optionally
    without those that hold a seed term, and the first ``max_total`` by sheet and row."""
    rows = mining.teacher_negatives(turns, "speaker", "utterance", "code", "behaviour")
    if seeds is not None:
        rows = mining.without_tokens(rows, "utterance", seeds, "term")
    rows = rows.orderBy("sheet", "row_no").limit(max_total) if max_total is not None else rows
    return rows.select(T.strip("utterance").alias("text"), "transcript_subtype", F.col("code").alias("transcript_code"), F.concat("sheet", F.lit("!R"), F.col("row_no").cast("string")).alias("transcript_ref"))


def text_negatives(spark: SparkSession, path: str, seeds: DataFrame, max_per_file: int | None = None) -> DataFrame:
    """(text, transcript_ref) of text transcripts, a line each, without lines that hold a seed term; the first
    ``max_per_file`` of each file. A line's reference is file#Ln."""
    rows = mining.without_tokens(transcript_lines(spark, path), "text", seeds, "term")
    rows = mining.capped(rows, "file", ["line_no"], max_per_file) if max_per_file is not None else rows
    return rows.select("text", F.concat("file", F.lit("#L"), F.col("line_no").cast("string")).alias("transcript_ref"))


def folders(names: list[str], wanted: list[str] | None = None, every: bool = False, doubled: str = "", keep: str = "_updated") -> list[str]:
    """The folders to score: the wanted ones as given, or every one in order, of those that begin with ``doubled`` only
    the ones that end in ``keep``. Neither given raises."""
    if wanted:
        return list(wanted)
    if not every:
        raise ValueError("name folders, or ask for every one")
    return [n for n in sorted(names) if not doubled or not n.startswith(doubled) or n.endswith(keep)]
