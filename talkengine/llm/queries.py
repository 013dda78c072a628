"""The registered queries of the package, each over its whole intended tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.runtime import load, written
from . import copies, defects, families, mixing, nearest, overlaps, packing, pii, spam, tokens


def _copy_records(spark: SparkSession, d: str) -> DataFrame:
    corpus = copies.canonical_records(load(spark, d, "corpus"), "utt_id", "utterance", "corpus")
    return corpus.union(copies.canonical_records(load(spark, d, "negatives"), "neg_id", "text", "negatives"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.find_copies(_copy_records(spark, d))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """One row per distinct record: table, kept id, number of copies."""
    return copies.counted(written(_copy_records(spark, d), "canonical")).select(F.col("grp").alias("table_name"), "kept_id", "n_copies")


def _defects(spark: SparkSession, d: str) -> DataFrame:
    return defects.judged(load(spark, d, "pairs"), "pair_id", "anchor_text", "variant_text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d).where("defect is not null").select(F.col("id").alias("pair_id"), "defect")


def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The words of each response by tag, and the defect."""
    return _defects(spark, d).withColumnRenamed("id", "pair_id")


def _anchor(c: str) -> F.Column:
    trimmed = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(trimmed != "", trimmed)


def _family_edges(spark: SparkSession, d: str) -> DataFrame:
    """(a, b): each pair with the anchor that it names."""
    pairs = load(spark, d, "pairs").select(F.col("pair_id").alias("id"), _anchor("anchor_id").alias("anchor")).where("id is not null")
    return pairs.select(F.concat(F.lit("p:"), "id").alias("a"), F.concat(F.lit("a:"), "anchor").alias("b"))


def _family_labels(spark: SparkSession, d: str) -> DataFrame:
    """(node, id, root): records and anchors with the root of their family."""
    utterances = load(spark, d, "corpus").select(F.col("utt_id").alias("id")).where("id is not null").distinct()
    edges = _family_edges(spark, d).distinct()
    _, labels = families.spanning_forest(edges)
    records = utterances.select(F.concat(F.lit("a:"), _anchor("id")).alias("node"), "id").union(edges.select("a", F.substring("a", 3, 1_000_000)))
    anchors = edges.where("b is not null").select(F.col("b").alias("node")).distinct()
    nodes = records.join(anchors, "node", "full_outer").select("node", "id")
    return nodes.join(labels, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))


def p3_forest(spark: SparkSession, d: str) -> DataFrame:
    """(a, b): the spanning forest of the families, from which new records can be contracted without the old edges."""
    return families.spanning_forest(_family_edges(spark, d))[0]


def _splits(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "splits").select("id", overlaps.split_name(F.col("split")).alias("split")).where("id is not null").groupBy("id").agg(F.max("split").alias("split"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _family_labels(spark, d).join(_splits(spark, d), "id", "left")
    anchor = F.max(F.when(F.col("node").startswith("a:"), F.substring("node", 3, 1_000_000)))
    torn = rows.groupBy("root").agg(anchor.alias("anchor_id"), F.min("split").alias("low"), F.max("split").alias("high"))
    return torn.where("low <> high and anchor_id is not null").select("anchor_id")


def p3_assignment(spark: SparkSession, d: str) -> DataFrame:
    """(id, family, split): a split for every record of corpus, pairs, negatives and splits, one per family."""
    known = _family_labels(spark, d).where("id is not null").select("id", "root")
    alone = load(spark, d, "negatives").select(F.col("neg_id").alias("id")).where("id is not null").union(_splits(spark, d).select("id")).distinct()
    rows = known.join(alone, "id", "full_outer").select("id", F.coalesce("root", F.concat(F.lit("r:"), "id")).alias("root"))
    rows = written(rows, "records")
    dealt = families.deal(rows.groupBy("root").agg(F.count("*").alias("size")))
    return rows.join(dealt.select("root", "split"), "root").select("id", F.col("root").alias("family"), "split")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    pairs = load(spark, d, "pairs").select(F.col("pair_id").alias("id"), F.col("variant_text").alias("text"))
    return pairs.union(load(spark, d, "negatives").select("neg_id", "text"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nearest.pairs(nearest.near_duplicates(_texts(spark, d)))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """(id, group_id, class_id, n_links) of every record that has a near-duplicate or a copy."""
    return nearest.groups(nearest.near_duplicates(_texts(spark, d)))


def _utterances(spark: SparkSession, d: str) -> DataFrame:
    corpus = load(spark, d, "corpus").select(F.col("utt_id").alias("id"), F.col("utterance").alias("text"))
    return corpus.union(load(spark, d, "negatives").select("neg_id", "text"))


#: The key of the registered queries; a production run passes its own secret.
_KEY = b"talkengine"


def _protected(spark: SparkSession, d: str) -> DataFrame:
    return pii.protected(_utterances(spark, d), "id", "text", _KEY)


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Texts with typed placeholders, and the types found."""
    return _protected(spark, d).select("id", "redacted", "pii_types")


def p5_surrogates(spark: SparkSession, d: str) -> DataFrame:
    """Texts with keyed surrogates in place of what is personal."""
    return _protected(spark, d).select("id", "surrogate_text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The types of what was replaced by surrogates in each record."""
    return _protected(spark, d).select("id", F.explode("pii_types").alias("pii_type"))


def _split_records(spark: SparkSession, d: str) -> DataFrame:
    texts = (
        load(spark, d, "corpus").select(F.col("utt_id").alias("id"), "source", F.col("utterance").alias("text"))
        .union(load(spark, d, "negatives").select("neg_id", "source_type", "text"))
        .union(load(spark, d, "pairs").select("pair_id", "register", "variant_text"))
    )
    return texts.join(_splits(spark, d).where("split is not null"), "id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = overlaps.overlaps(_split_records(spark, d))
    return found.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.report(overlaps.search(_split_records(spark, d)))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_counts(load(spark, d, "documents"), "doc_id", "text", {"source": "source"})


def _capacities(spark: SparkSession, d: str) -> dict[str, int]:
    return {r[0]: int(r[1]) for r in load(spark, d, "container_sizes").select("container_name", "capacity_tokens").collect()}


def _named(packed: DataFrame) -> DataFrame:
    return packed.select("container_name", F.col("id").alias("doc_id"), "piece", "start_token", "n_tokens", "container_id", "step_group")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of each text (or piece of a text over the capacity), for each capacity."""
    sizes = written(_sizes(spark, d), "sizes")
    return _named(packing.pack(sizes, _capacities(spark, d)))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """The fill of each container, for each capacity."""
    return packing.fills(packing.pack(written(_sizes(spark, d), "sizes"), _capacities(spark, d)))


def p7_tiers(spark: SparkSession, d: str) -> DataFrame:
    """One packing with windows of all capacities: each text in its own tier or in a gap of a longer one."""
    return _named(packing.pack_tiers(written(_sizes(spark, d), "sizes"), _capacities(spark, d)))


def p8_uses(spark: SparkSession, d: str) -> DataFrame:
    """The documents drawn, with the number of uses."""
    return mixing.mix(_sizes(spark, d), load(spark, d, "mix_targets")).withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    targets = load(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(_sizes(spark, d), targets), targets)


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Words by kind, recurrence and autocorrelation of every document."""
    return spam.scored(load(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_scores(spark, d).where("spam").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_records, p2_found, p2_coverage, p3_found, p3_assignment, p3_forest, p4_found, p4_groups, p5_found, p5_redacted, p5_surrogates, p6_found, p6_report, p7_containers, p7_fill, p7_tiers, p8_uses, p8_shares, p9_found, p9_scores)
}
SQL: dict[str, str] = {
    "p3_found": r"""with f as (select distinct lower(regexp_replace(utt_id, '^\s+|\s+$', '', 'g')) as anchor_id, utt_id as id from corpus
    union select distinct lower(regexp_replace(anchor_id, '^\s+|\s+$', '', 'g')), pair_id from pairs where regexp_replace(anchor_id, '^\s+|\s+$', '', 'g') <> ''),
n as (select id, lower(regexp_replace(split, '^\s+|\s+$', '', 'g')) as split from splits),
s as (select id, max(case when split = 'validation' then 'val' else split end) as split from n where split in ('train', 'val', 'validation', 'test') group by id)
select anchor_id from f join s using (id) group by anchor_id having min(s.split) <> max(s.split)""",
}
