"""Sub-type labelling: cue rules, keyword scan, the cascade to a model, and the distribution check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import SENTINEL, category_subtypes, listed, strings, term_subtypes
from ..functions.text import NO_WORD, has_term, padded_words

#: The seed vocabulary is broadcast up to this many rows; beyond it the joins shuffle.
SEED_ROWS = 200_000


def seed_index(seeds: DataFrame) -> DataFrame:
    """(token, tier, category): every term and variant in lower case; of equal tokens the seed last in term order wins."""
    tokens = F.transform(F.array_union(F.array(F.col("term")), listed("variants")), lambda t: F.trim(F.lower(t)))
    rows = seeds.where("term is not null").select(F.explode(tokens).alias("token"), "tier", "category", "term").where("token <> ''")
    return rows.groupBy("token").agg(F.max_by(F.struct("tier", "category"), "term").alias("s")).select("token", "s.tier", "s.category")


def _small(df: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def cue_rules(df: DataFrame, id_: str, tier2: str, tier3: str, index: DataFrame) -> DataFrame:
    """(id, labels): per tier-2 cue the term's own label, else its category's, else observation; content for any tier-3 cue."""
    base = df.select(F.col(id_).alias("id"), listed(tier2).alias("t2"), listed(tier3).alias("t3"))
    cues = base.select("id", F.explode("t2").alias("cue")).withColumn("token", F.lower(F.trim("cue")))
    hit = cues.join(_small(index.select("token", "category"), SEED_ROWS), "token", "left")
    labels = F.coalesce(term_subtypes(F.col("token")), F.when(F.col("category").isNotNull(), category_subtypes(F.col("category"))), strings("observation"))
    found = hit.select("id", F.explode(labels).alias("label")).union(base.where(F.size("t3") > 0).select("id", F.lit("content")))
    return found.groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("labels"))  # at most six labels


def word_list(text: Column | str) -> Column:
    return F.filter(F.split(F.trim(padded_words(text)), " "), lambda x: x != "")


def grams(w: str, longest: int) -> Column:
    """The distinct runs of one to ``longest`` words of an array column (a column, as lambdas evaluate it again and again)."""

    def runs(n: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, made).otherwise(strings())

    return F.array_distinct(F.concat(F.col(w), *[runs(n) for n in range(2, longest + 1)]))


def keyword_labels(df: DataFrame, id_: str, text: str, index: DataFrame) -> DataFrame:
    """(id, labels) by whole-word hits: content for tier 3, else the term's own label, else its category's.

    The theta join text-contains-token becomes an equi-join of the text's word runs with the vocabulary.
    """
    cut = df.where(F.col(text).isNotNull()).select(F.col(id_).alias("id"), F.col(text).alias("_text"), word_list(text).alias("w"))
    known = index.withColumn("_run", F.array_join(word_list("token"), " ")).where("_run <> ''")
    longest = known.agg(F.max(F.size(F.split("_run", " ")))).first()[0] or 1  # words of the longest token
    runs = cut.select("id", "_text", F.explode(grams("w", longest)).alias("_run"))
    exact = ~F.col("token").rlike(NO_WORD) | has_term("_text", "token")  # signs and double blanks of a token count too
    hit = runs.join(_small(known, SEED_ROWS), "_run").where(exact)
    labels = F.when(F.col("tier") == "TIER3", strings("content")).otherwise(F.coalesce(term_subtypes(F.col("token")), category_subtypes(F.col("category"))))
    return hit.select("id", F.explode(labels).alias("label")).groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def cascade(df: DataFrame, id_: str, text: str, tier2: str | None, tier3: str | None, index: DataFrame, scan: bool = True, model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, subtype, subtype_source, subtype_confidence): rule, rule+keyword, keyword, then a model for what is left.

    ``model`` takes (id, text) of the unlabelled rows only and gives (id, subtype, subtype_confidence); the rows are
    filtered before it, as a conditional expression would run it on all of them. Without one: observation, 0.
    """
    ids = df.select(F.col(id_).alias("id"), F.col(text).alias("text")).dropDuplicates(["id"])
    none = ids.limit(0).select("id", strings().alias("labels"))
    rule = cue_rules(df, id_, tier2, tier3, index) if tier2 and tier3 else none
    word = keyword_labels(df, id_, text, index) if scan else none
    both = ids.join(rule.withColumnRenamed("labels", "r"), "id", "left").join(word.withColumnRenamed("labels", "k"), "id", "left")
    r, k = listed("r"), listed("k")
    fresh = F.size(F.array_except(k, r)) > 0
    source = F.when((F.size(r) > 0) & fresh, "rule+keyword").when(F.size(r) > 0, "rule").when(F.size(k) > 0, "keyword")
    labelled = both.select("id", "text", F.array_sort(F.array_union(r, k)).alias("subtype"), source.alias("subtype_source"))
    done = labelled.where("subtype_source is not null").select("id", "subtype", "subtype_source", F.lit(1.0).alias("subtype_confidence"))
    rest = labelled.where("subtype_source is null").select("id", "text")
    made = model(rest) if model else rest.select("id", strings("observation").alias("subtype"), F.lit(0.0).alias("subtype_confidence"))
    return done.unionByName(made.select("id", "subtype", F.lit("llm").alias("subtype_source"), "subtype_confidence"))


def distribution(df: DataFrame, subtype: str, dominance: float = 0.70) -> DataFrame:
    """(label, n, share, dominant) over exploded labels; the share is of rows."""
    total = df.agg(F.count("*").alias("rows"))
    by = df.select(F.explode(subtype).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    out = by.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("rows"))  # one row
    return out.select("label", "n", "share", (F.col("share") > dominance).alias("dominant"))


def coverage(df: DataFrame, subtype: str) -> DataFrame:
    """One row: rows, rows without label, rows with a practice label, rows of content only, rows of the sentinel."""
    s = listed(subtype)
    practice = F.arrays_overlap(s, strings("observation", "prediction", "causal_reasoning", "evidence"))
    return df.agg(F.count("*").alias("n"), F.count_if(F.size(s) == 0).alias("unlabelled"), F.count_if(practice).alias("practice"),
                  F.count_if((F.size(s) == 1) & F.array_contains(s, "content")).alias("content_only"), F.count_if(F.array_contains(s, SENTINEL)).alias("not_science"))
