"""Inputs of evaluations and audits: queries by split, slices, gold pairs, and comparisons of two orders or prompts.

Samples are the first rows by md5(seed | id), so they are repeatable and do not depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.arrays import joined_subtypes
from .metrics import confusion, ranking_metrics, spearman
from .relate import net_new
from .sampling import order_key, ranked, round_robin


def ids_of(splits: DataFrame, kind: str, split: str) -> DataFrame:
    """(id) of a kind in a split."""
    return splits.where((F.col("kind") == kind) & (F.col("split") == split)).select("id").distinct()


def first_by_seed(rows: DataFrame, id_: str, n: int, seed: int) -> DataFrame:
    return rows.orderBy(order_key(seed, id_), id_).limit(n)


def split_queries(corpus: DataFrame, pairs: DataFrame, negatives: DataFrame, splits: DataFrame, split: str, n_pos: int, n_neg: int, seed: int = 42) -> DataFrame:
    """(id, phrase, label, gold_anchor, subtype): variants of the split with their anchor and its sub-types, and negatives;
    the first of each by seed. Inputs: (utt_id, subtype), (pair_id, anchor_id, variant_text), (neg_id, text), splits."""
    anchors = corpus.select(F.col("utt_id").alias("gold_anchor"), joined_subtypes("subtype").alias("subtype"))
    pos = pairs.where("variant_text is not null").join(ids_of(splits, "pair", split), F.col("pair_id") == F.col("id"), "left_semi")
    pos = first_by_seed(pos.select(F.col("pair_id").alias("id"), F.col("variant_text").alias("phrase"), F.col("anchor_id").alias("gold_anchor")), "id", n_pos, seed)
    pos = pos.join(anchors, "gold_anchor", "left").select("id", "phrase", F.lit(1).alias("label"), "gold_anchor", F.coalesce("subtype", F.lit("unknown")).alias("subtype"))
    neg = negatives.join(ids_of(splits, "negative", split), F.col("neg_id") == F.col("id"), "left_semi")
    neg = first_by_seed(neg.select(F.col("neg_id").alias("id"), F.col("text").alias("phrase")), "id", n_neg, seed)
    return pos.unionByName(neg.select("id", "phrase", F.lit(0).alias("label"), F.lit(None).cast("string").alias("gold_anchor"), F.lit("negative").alias("subtype")))


def slice_queries(slice_: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(id, phrase, label, gold_anchor, subtype) of slice rows (id, text, anchor_id, subtype), the first n by seed."""
    rows = slice_.select("id", F.col("text").alias("phrase"), F.lit(1).alias("label"), F.col("anchor_id").alias("gold_anchor"), joined_subtypes("subtype").alias("subtype"))
    return first_by_seed(rows, "id", n, seed)


def slice_families(corpus: DataFrame, pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(id, kind, text, anchor_id, register, slice_reason): the held-out anchors (id, slice_reason) and all their variants."""
    a = corpus.select(F.col("utt_id").alias("id"), F.col("utterance").alias("text")).join(held, "id").select("id", F.lit("positive").alias("kind"), "text", F.col("id").alias("anchor_id"), F.lit(None).cast("string").alias("register"), "slice_reason")
    p = pairs.select("pair_id", F.col("variant_text").alias("text"), "anchor_id", "register").join(held.withColumnRenamed("id", "anchor_id"), "anchor_id")
    return a.unionByName(p.select(F.col("pair_id").alias("id"), F.lit("pair").alias("kind"), "text", "anchor_id", "register", "slice_reason"))


def slice_summary(rows: DataFrame) -> DataFrame:
    """(slice_reason, kind, register, n), no register as '(none)'; the totals of a reason have null kind and register."""
    r = rows.select("slice_reason", "kind", F.coalesce("register", F.lit("(none)")).alias("register"))
    sets = r.groupingSets([[F.col("slice_reason")], [F.col("slice_reason"), F.col("kind"), F.col("register")]], F.col("slice_reason"), F.col("kind"), F.col("register"))
    return sets.agg(F.count("*").alias("n"))


def training_triples(pairs: DataFrame, corpus: DataFrame, hard: DataFrame, seed: int = 17) -> DataFrame:
    """(pair_id, anchor_id, query, positive, hard_negative): the anchor's hard negatives (neg_id, anchor_id, text) are dealt
    in turn to its pairs (pair_id, anchor_id, query), both in seeded order; an anchor without any gives null."""
    h = ranked(hard, ["anchor_id"], order_key(seed, "neg_id"), "_turn", "_n").select("anchor_id", "_turn", F.col("text").alias("hard_negative"))
    n = h.groupBy("anchor_id").agg(F.max("_turn").alias("_n"))
    p = ranked(pairs, ["anchor_id"], order_key(seed, "pair_id"), "_k", "_size").join(n, "anchor_id", "left").withColumn("_turn", (F.col("_k") - 1) % F.col("_n") + 1)
    return p.join(corpus, "anchor_id").join(h, ["anchor_id", "_turn"], "left").select("pair_id", "anchor_id", "query", "positive", "hard_negative")


def training_examples(triples: DataFrame, query_prefix: str = "search_query: ", document_prefix: str = "search_document: ") -> DataFrame:
    """(pair_id, texts): query and positive, and the hard negative where there is one, with the encoder's prefixes."""
    doc = lambda c: F.concat(F.lit(document_prefix), F.col(c))
    return triples.select("pair_id", F.array_compact(F.array(F.concat(F.lit(query_prefix), "query"), doc("positive"), doc("hard_negative"))).alias("texts"))


def retrieval_inputs(corpus: DataFrame, pairs: DataFrame, negatives: DataFrame, splits: DataFrame, split: str = "val", distractors: int = 1000, seed: int = 17) -> DataFrame:
    """(role, id, text, relevant): queries with the anchor that answers them, anchors, and negatives as distractors.

    Queries whose anchor is not in the bank take no part.
    """
    bank = corpus.select(F.col("utt_id").alias("id"), F.col("utterance").alias("text"))
    q = pairs.where("variant_text is not null").join(ids_of(splits, "pair", split), F.col("pair_id") == F.col("id"), "left_semi")
    q = q.join(bank.select(F.col("id").alias("anchor_id")), "anchor_id", "left_semi")
    d = negatives.join(ids_of(splits, "negative", split), F.col("neg_id") == F.col("id"), "left_semi").select(F.col("neg_id").alias("id"), "text")
    none = F.lit(None).cast("string")
    return (
        q.select(F.lit("query").alias("role"), F.col("pair_id").alias("id"), F.col("variant_text").alias("text"), F.col("anchor_id").alias("relevant"))
        .unionByName(bank.select(F.lit("anchor").alias("role"), "id", "text", none.alias("relevant")))
        .unionByName(first_by_seed(d, "id", distractors, seed).select(F.lit("distractor").alias("role"), "id", "text", none.alias("relevant")))
    )


def pair_audit(corpus: DataFrame, pairs: DataFrame, negatives: DataFrame, splits: DataFrame, n: int = 100, split: str = "val", seed: int = 42) -> DataFrame:
    """(id, query, candidate, label, anchor_id): n // 2 variants with their anchor's text (1), and n // 2 negatives, each
    with the anchor whose turn it is (0)."""
    half = max(1, n // 2)
    bank = corpus.where("utterance <> ''").select(F.col("utt_id").alias("anchor_id"), F.col("utterance").alias("query"))
    pos = pairs.where("variant_text is not null").join(ids_of(splits, "pair", split), F.col("pair_id") == F.col("id"), "left_semi").join(bank, "anchor_id")
    pos = pos.select(F.col("pair_id").alias("id"), "query", F.col("variant_text").alias("candidate"), F.lit(1).alias("label"), "anchor_id")
    neg = negatives.join(ids_of(splits, "negative", split), F.col("neg_id") == F.col("id"), "left_semi").select("neg_id", F.col("text").alias("candidate"))
    dealt = round_robin(first_by_seed(neg, "neg_id", half, seed), "neg_id", pos.select(F.col("id").alias("pair")), "pair", seed).join(pos.select(F.col("id").alias("pair"), "query"), "pair")
    zero = dealt.select(F.col("neg_id").alias("id"), "query", "candidate", F.lit(0).alias("label"), F.lit(None).cast("string").alias("anchor_id"))
    return first_by_seed(pos, "id", half, seed).unionByName(zero)


def system_summary(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(system, threshold, n, precision, recall, f1) of (system, score, label) at the thresholds (system, threshold)."""
    rows = scored.join(F.broadcast(thresholds), "system")  # one row per system
    out = confusion(rows, F.col("label") == 1, F.col("score") >= F.col("threshold"), ["system", "threshold"])
    return out.select("system", "threshold", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"), "precision", "recall", "f1")


def subtype_breakdown(scored: DataFrame, threshold: float) -> DataFrame:
    """(subtype, n, recall) of the positives (label, subtype, score)."""
    return scored.where("label = 1").groupBy("subtype").agg(F.count("*").alias("n"), F.avg((F.col("score") >= threshold).cast("int")).alias("recall"))


def rerank_comparison(candidates: DataFrame, llm: Column, k: int = 10) -> DataFrame:
    """(system, the ranking metrics): the order by similarity and the order by model score (null last, ties by falling id),
    from (query_id, id, similarity, rank, relevant)."""
    again = F.row_number().over(W.partitionBy("query_id").orderBy(llm.desc_nulls_last(), F.col("id").desc()))
    rows = candidates.withColumn("_again", again)
    a = ranking_metrics(rows.select("query_id", "rank", "relevant"), k).select(F.lit("bi_encoder").alias("system"), "*")
    return a.unionByName(ranking_metrics(rows.select("query_id", F.col("_again").alias("rank"), "relevant"), k).select(F.lit("reranked").alias("system"), "*"))


def stability(scored: DataFrame, first: str, second: str, gate: float = 0.90) -> DataFrame:
    """One row (n, spearman, stable): do two phrasings of a prompt order the same pairs alike?"""
    return spearman(scored, first, second).withColumn("stable", F.coalesce(F.col("spearman") >= gate, F.lit(False)))


def negative_checks(negatives: DataFrame, n_positives: int, subtypes: tuple[str, ...], sources: tuple[str, ...], ratio: float = 3.0) -> DataFrame:
    """(check, value, ok): size against the positives, sources, sub-types without rows, repeated ids, missing texts."""
    have = F.collect_set("source_type")
    row = negatives.select("neg_id", "text", "source_type", "subtype").agg(
        F.count("*").alias("n"), F.count_distinct("neg_id").alias("ids"), F.count_if(F.col("text").isNull()).alias("untexted"),
        F.size(F.array_except(F.array(*map(F.lit, sources)), have)).alias("no_source"), *[F.count_if(F.array_contains("subtype", t)).alias(f"s_{t}") for t in subtypes])
    missing = sum((F.when(F.col(f"s_{t}") == 0, 1).otherwise(0) for t in subtypes), F.lit(0))
    cells = [("rows", F.col("n"), F.col("n") >= ratio * n_positives), ("repeated_ids", F.col("n") - F.col("ids"), F.col("n") == F.col("ids")), ("missing_texts", F.col("untexted"), F.col("untexted") == 0),
             ("missing_sources", F.col("no_source"), F.col("no_source") == 0), ("missing_subtypes", missing, missing == 0)]
    made = F.array(*[F.struct(F.lit(name).alias("check"), v.cast("long").alias("value"), ok.alias("ok")) for name, v, ok in cells])
    return row.select(F.explode(made).alias("c")).select("c.*")


def mined_totals(rows: DataFrame, canon: Column, corpus: DataFrame, corpus_canon: Column) -> DataFrame:
    """One row (n_raw, n_text, n_distinct, n_known, n_new) of mined texts against the corpus."""
    r = rows.select(canon.alias("c"))
    by = r.groupBy("c").agg(F.count("*").alias("n"))
    new = net_new(by.where("c <> ''"), corpus, F.col("c"), corpus_canon).agg(F.count("*").alias("n_new"))
    all_ = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_raw"), F.coalesce(F.sum(F.when(F.col("c") != "", F.col("n"))), F.lit(0)).alias("n_text"), F.count_if(F.col("c") != "").alias("n_distinct"))
    return all_.crossJoin(new).select("n_raw", "n_text", "n_distinct", (F.col("n_distinct") - F.col("n_new")).alias("n_known"), "n_new")  # one row by one row
