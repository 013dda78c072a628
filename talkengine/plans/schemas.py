"""Declared schemas of the tables, and readers that add absent columns as typed nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = {
    "corpus": "utt_id string, utterance string, label string, setting string, source string, tier2_cues array<string>, tier3_cues array<string>, was_sci_coded int, transcript_ref string, topic string, citation string, subtype array<string>, subtype_source string, subtype_confidence double, subtype_prompt_version string",
    "seed_words": "term string, tier string, category string, variants array<string>, curriculum_source string, source_url string",
    "category_defs": "label string, type string, definition string, include_if string, exclude_if string, examples string",
    "negatives": "neg_id string, text string, source_type string, subtype array<string>, subtype_source string, subtype_confidence double, subtype_prompt_version string, transcript_subtype string, transcript_code string, transcript_ref string, anchor_utt_id string, anchor_seed_term string, structural_check_passed boolean, llm_gate_score double, model_id string, prompt_version string, human_verified boolean, human_label string",
    "pairs": "pair_id string, anchor_id string, anchor_text string, anchor_setting string, source_register string, variant_text string, register string, subtype array<string>, preserved_cues array<string>, preservation_pct double, preservation_check_passed boolean, differs_from_anchor boolean, llm_self_score double, prompt_version string, model_id string, created_at timestamp_ntz",
    "review_decisions": "id string, kind string, decision string, reviewer string, decided_at timestamp_ntz, corrected_text string, reject_reason string, reject_notes string",
    "splits": "id string, kind string, label string, stratify_key string, anchor_id string, split string",
    "transcript_scored": "source_file string, line_no int, child_id string, seg_start string, seg_end string, speaker string, utterance string, confidence double, cosine_score double, top_match_utt_id string, llm_score double, scored_by string, predicted_label string, score double",
}


def conformed(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order and type, absent ones null, others left out."""
    empty = df.sparkSession.createDataFrame([], TABLES[table])
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema.fields])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def corpus_problems(corpus: DataFrame, least: int = 195, least_by_label: dict[str, int] | None = None, settings: tuple[str, ...] = ()) -> list[str]:
    """What a corpus lacks, from one aggregation: rows, unique ids, texts, rows per label, known settings."""
    by = least_by_label if least_by_label is not None else {"SCIENCE_TALK": 188, "NOT_SCIENCE_TALK": 5}
    row = corpus.agg(
        F.count("*").alias("n"), F.count_distinct("utt_id").alias("ids"), F.count_if(F.col("utterance").isNull()).alias("untexted"),
        F.count_if(~F.col("setting").isin(*settings) if settings else F.lit(False)).alias("unknown"), *[F.count_if(F.col("label") == k).alias(f"label_{k}") for k in by]).first()
    out = [f"{row['n']} rows, {least} wanted"] * (row["n"] < least) + ["ids repeat"] * (row["ids"] < row["n"]) + ["rows without text"] * (row["untexted"] > 0) + ["unknown settings"] * (row["unknown"] > 0)
    return out + [f"{row[f'label_{k}']} rows of {k}, {v} wanted" for k, v in by.items() if row[f"label_{k}"] < v]
