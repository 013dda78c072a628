"""Dense retrieval: exact top-k in blocks, classification, deduplicated scoring, the deterministic pair scorer.

A stated set of queries is compared with all rows. Both sides are dealt to blocks of bounded size; each query block
meets each bank block in one task, which keeps k per query, and the partial lists merge by a window. Nothing but two
counts comes to the driver, and the plan does not grow with the data. Similarities are rounded to 6 places, ties go to
the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLOCK = 8192
BANK_BLOCK = 65_536


def _best_of(k: int, by_query: bool):
    """The k nearest bank vectors of each query of a pair of blocks, leaving out a row as its own candidate."""

    def run(queries: pd.DataFrame, bank: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(bank):
            bank = bank.sort_values("id", kind="stable")
            vectors, names = np.stack(bank["v"].to_numpy()).astype(np.float64), bank["id"].to_numpy()
            for at in range(0, len(queries), 512):
                some = queries.iloc[at : at + 512]
                sims = np.round(np.stack(some["v"].to_numpy()).astype(np.float64) @ vectors.T, 6)
                own = some["id"].to_numpy()
                m = min(k + by_query, len(names))
                # ties at the cut go to the smaller id: all that reach the m-th best, then in order
                cut = -np.partition(-sims, m - 1, axis=1)[:, m - 1 : m]
                q, i = np.nonzero(sims >= cut)
                order = np.lexsort((i, -sims[q, i], q))
                q, i = q[order], i[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                q, i = q[place < m], i[place < m]
                keep = own[q] != names[i] if by_query else np.ones(len(q), bool)
                found.append(pd.DataFrame({"query_id": own[q[keep]], "id": names[i[keep]], "similarity": sims[q[keep], i[keep]]}))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"query_id": queries["id"].iloc[:0], "id": bank["id"].iloc[:0], "similarity": pd.Series(dtype="float64")})

    return run


def _partials(bank: DataFrame, queries: DataFrame, k: int, by_query: bool, block: int, bank_block: int) -> DataFrame:
    name, kind = (df.schema["id"].dataType.simpleString() for df in (bank, queries))
    blocks, banks = max(1, -(-queries.count() // block)), max(1, -(-bank.count() // bank_block))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        mine = df.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(own))
        return mine.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    q, b = dealt(queries, "qb", blocks, "bb", banks), dealt(bank, "bb", banks, "qb", blocks)
    met = q.groupBy("qb", "bb").cogroup(b.groupBy("qb", "bb"))
    return met.applyInPandas(_best_of(k, by_query), f"query_id {kind}, id {name}, similarity double")


def top_k(bank: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK, bank_block: int = BANK_BLOCK, itself: bool = False) -> DataFrame:
    """(query_id, id, similarity, rank) from (id, v) tables of unit vectors; a row is no candidate of itself, unless the
    ids of queries and bank have nothing to do with each other (``itself``)."""
    parts = _partials(bank, queries, k, not itself, block, bank_block)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))  # k rows per bank block
    return parts.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(bank: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``top_k`` for queries that are no rows of the bank."""
    return top_k(bank, queries, k, itself=True)


def classified(candidates: DataFrame, threshold: float, how: str = "max", score: str = "similarity") -> DataFrame:
    """(query_id, score, label, best_id, n_candidates): max or mean of the candidates' scores against a threshold."""
    value = F.max(score) if how == "max" else F.avg(score)
    out = candidates.groupBy("query_id").agg(F.round(value, 6).alias("score"), F.min_by("id", "rank").alias("best_id"), F.count("*").alias("n_candidates"))
    return out.withColumn("label", F.when(F.col("score") >= threshold, "SCIENCE_TALK").otherwise("NOT_SCIENCE_TALK"))


def reranked(candidates: DataFrame, llm: Column, threshold: float, degraded_threshold: float) -> DataFrame:
    """(query_id, score, label, degraded): the best model score; where every one is null, the best similarity."""
    by = candidates.withColumn("_llm", llm).groupBy("query_id").agg(F.max("_llm").alias("llm"), F.max("similarity").alias("cosine"))
    degraded = F.col("llm").isNull()
    score = F.coalesce("llm", "cosine")
    ok = F.when(degraded, score >= degraded_threshold).otherwise(score >= threshold)
    return by.select("query_id", score.alias("score"), F.when(ok, "SCIENCE_TALK").otherwise("NOT_SCIENCE_TALK").alias("label"), degraded.alias("degraded"))


def rerank_order(candidates: DataFrame, llm: str = "llm") -> DataFrame:
    """Adds ``position`` by model score (null last), similarity and id."""
    w = W.partitionBy("query_id").orderBy(F.coalesce(F.col(llm), F.lit(-1.0)).desc(), F.desc("similarity"), "id")
    return candidates.withColumn("position", F.row_number().over(w))


def scored_once(rows: DataFrame, text: str, score, key: str = "_text") -> DataFrame:
    """``score`` applied to the distinct texts only (DataFrame -> DataFrame keyed by text), joined back to all rows."""
    distinct = rows.select(F.col(text).alias(key)).where(F.col(key).isNotNull()).distinct()
    return rows.withColumn(key, F.col(text)).join(score(distinct), key, "left").drop(key)


def best_match(rows: DataFrame, bank: DataFrame, block: int = BANK_BLOCK, rows_block: int = BANK_BLOCK) -> DataFrame:
    """(id, match_id, similarity): for each of many rows (id, v) the nearest of a bank (id, v), block by block."""
    parts = _partials(bank, rows, 1, False, rows_block, block)
    best = F.min_by(F.struct(F.col("id").alias("match_id"), "similarity"), F.struct((-F.col("similarity")).alias("s"), "id"))
    return parts.groupBy(F.col("query_id").alias("id")).agg(best.alias("m")).select("id", "m.match_id", "m.similarity")
