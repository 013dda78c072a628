"""The query path as one object: phrases in, labels and ranked candidates out.

``QueryPipeline`` holds the anchor bank, an encoder and a pair scorer. ``retrieve`` gives the candidates, ``classify``
re-ranks them and falls back to the similarity where no answer came; both take any number of phrases at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.arrays import joined_subtypes
from . import retrieval
from .encoders import encoded

Scorer = Callable[[DataFrame], DataFrame]


@dataclass
class QueryPipeline:
    bank: DataFrame  #: (id, v, utterance, subtype) of the anchors, vectors of unit length
    encoder: Callable  #: builds the model of a task, see ``encoders.encoded``
    scorer: Scorer | None = None  #: adds llm_score, rationale and error to (query_id, phrase, id, utterance, ...)
    config: dict | None = None
    prefix: str = "search_query: "

    def __post_init__(self) -> None:
        from ..plans.config import load_config

        self.config = load_config(part="query") | (self.config or {})
        missing = {"id", "v", "utterance"} - set(self.bank.columns)
        if missing:
            raise ValueError(f"the bank lacks {sorted(missing)}")

    def retrieve(self, phrases: DataFrame, top_k: int | None = None) -> DataFrame:
        """(query_id, phrase, id, utterance, subtype, similarity, rank) of (query_id, phrase); distinct phrases are encoded
        once. Blank phrases are similar to nothing (0)."""
        vectors = retrieval.scored_once(phrases.select("query_id", "phrase"), "phrase", lambda t: encoded(t, "_text", self.encoder, self.prefix))
        queries = vectors.where("vector is not null").select(F.col("query_id").alias("id"), F.col("vector").alias("v"))
        found = retrieval.nearest(self.bank.select("id", "v"), queries, top_k or self.config["top_k"])
        own = joined_subtypes("subtype") if "subtype" in self.bank.columns else F.lit(None).cast("string")
        return found.join(phrases.select("query_id", "phrase"), "query_id").join(self.bank.select("id", "utterance", own.alias("subtype")), "id")

    def rerank(self, candidates: DataFrame) -> DataFrame:
        """The candidates with llm_score, rationale and error (null where there is no scorer), and their new position."""
        none = {c: F.lit(None).cast(t) for c, t in (("llm_score", "double"), ("rationale", "string"), ("error", "string"))}
        return retrieval.rerank_order(self.scorer(candidates) if self.scorer else candidates.withColumns(none), "llm_score")

    def classify(self, phrases: DataFrame, top_k: int | None = None) -> DataFrame:
        """(query_id, phrase, score, label, degraded, best_id, n_candidates), one row per phrase; a phrase without
        candidates scores 0."""
        c = self.config
        out = verdicts(self.rerank(self.retrieve(phrases, top_k)), c["score_threshold"], c["degraded_cosine_threshold"], c["aggregation"])
        rows = phrases.select("query_id", "phrase").join(out, "query_id", "left")
        return rows.select("query_id", "phrase", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("label", F.lit("NOT_SCIENCE_TALK")).alias("label"), F.coalesce("degraded", F.lit(True)).alias("degraded"), "best_id", F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"))


def verdicts(ranked: DataFrame, threshold: float, degraded_threshold: float, how: str = "max") -> DataFrame:
    """(query_id, score, label, degraded, best_id, n_candidates) of (query_id, id, similarity, llm_score, position)."""
    value = F.max("llm_score") if how == "max" else F.avg("llm_score")
    by = ranked.groupBy("query_id").agg(value.alias("llm"), F.max("similarity").alias("cosine"), F.min_by("id", "position").alias("best_id"), F.count("*").alias("n_candidates"))
    degraded = F.col("llm").isNull()
    ok = F.when(degraded, F.col("cosine") >= degraded_threshold).otherwise(F.col("llm") >= threshold)
    return by.select("query_id", F.coalesce("llm", "cosine").alias("score"), F.when(ok, "SCIENCE_TALK").otherwise("NOT_SCIENCE_TALK").alias("label"), degraded.alias("degraded"), "best_id", "n_candidates")
