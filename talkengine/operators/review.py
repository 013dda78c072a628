"""Human review: queue, decision checks, upsert, application, the verified view, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import blank_to_null, strip
from .relate import keep_last, updated, with_columns_present
from .sampling import spot_sample

# Decisions and the reasons a rejection may give.
DECISIONS = ("accept", "reject", "edit")
REJECT_REASONS = ("register_mismatch", "meaning_drift", "anchor_copy", "not_actually_negative", "implausible_classroom", "nonsense", "duplicate", "pii", "other")
DECISION_COLUMNS = {"decision": "string", "reviewer": "string", "decided_at": "timestamp", "corrected_text": "string", "reject_reason": "string", "reject_notes": "string"}


def queue(rows: DataFrame, decided: DataFrame, rate: float = 0.12, seed: int = 42) -> DataFrame:
    """(id, kind, routing) to review: all of 'review' and a sample of 'spot' per kind, without what is decided."""
    todo = rows.where("routing = 'review'").unionByName(spot_sample(rows.where("routing = 'spot'"), ["kind"], "id", rate, seed))
    return todo.join(decided.select("id").distinct(), "id", "left_anti").dropDuplicates(["id"])


def problems(decisions: DataFrame) -> DataFrame:
    """(id, problem) of every decided row that breaks a rule: unknown decision, rejection without a known reason, edit without text."""
    d, reason = F.lower(blank_to_null("decision")), F.lower(blank_to_null("reject_reason"))
    bad = F.array_compact(F.array(
        F.when(~d.isin(*DECISIONS), "unknown decision"), F.when((d == "reject") & (reason.isNull() | ~reason.isin(*REJECT_REASONS)), "no valid reason"),
        F.when((d == "edit") & blank_to_null("corrected_text").isNull(), "no corrected text")))
    return decisions.where(d.isNotNull()).select("id", F.explode(bad).alias("problem"))


def decided(decisions: DataFrame) -> DataFrame:
    """The rows with a valid decision, normalised."""
    clean = decisions.withColumns({"decision": F.lower(blank_to_null("decision")), "reject_reason": F.lower(blank_to_null("reject_reason")), "corrected_text": blank_to_null("corrected_text")})
    d = F.col("decision")
    ok = d.isin(*DECISIONS) & ~((d == "reject") & ~F.coalesce(F.col("reject_reason").isin(*REJECT_REASONS), F.lit(False))) & ~((d == "edit") & F.col("corrected_text").isNull())
    return clean.where(ok)


def latest(decisions: DataFrame) -> DataFrame:
    """The newest decision per id; of equal times the greater in order of its columns. Applying it again changes nothing."""
    rest = [c for c in decisions.columns if c not in ("id", "decided_at")]
    return keep_last(decisions, ["id"], ["decided_at", *rest])


def applied(rows: DataFrame, id_: str, decisions: DataFrame) -> DataFrame:
    """The decision columns of the newest decisions written onto the rows."""
    return updated(rows, latest(decisions).withColumnRenamed("id", id_), id_, list(DECISION_COLUMNS))


def verified(rows: DataFrame, text: str) -> DataFrame:
    """Accepted and edited rows, and undecided ones that are routed nowhere or to 'auto'; edits replace the text."""
    rows = with_columns_present(rows, DECISION_COLUMNS | {"routing": "string"})
    d, r = blank_to_null("decision"), F.lower(blank_to_null("routing"))
    kept = rows.where(d.isin("accept", "edit") | (d.isNull() & (r.isNull() | (r == "auto"))))
    return kept.withColumn(text, F.when(d == "edit", F.col("corrected_text")).otherwise(F.col(text)))


def status(rows: DataFrame, decisions: DataFrame, rate: float = 0.12) -> DataFrame:
    """(kind, review_total, review_decided, spot_total, spot_decided, spot_target, complete)."""
    done = decisions.select("id", F.lit(True).alias("_done")).distinct()
    r = rows.join(done, "id", "left").groupBy("kind").agg(
        F.count_if(F.col("routing") == "review").alias("review_total"), F.count_if((F.col("routing") == "review") & F.col("_done")).alias("review_decided"),
        F.count_if(F.col("routing") == "spot").alias("spot_total"), F.count_if((F.col("routing") == "spot") & F.col("_done")).alias("spot_decided"))
    target = F.when(F.col("spot_total") > 0, F.greatest(F.lit(1), F.bround(F.col("spot_total") * rate))).otherwise(0).cast("long")
    r = r.withColumn("spot_target", target)
    return r.withColumn("complete", (F.col("review_total") == F.col("review_decided")) & (F.col("spot_decided") >= F.col("spot_target")))


def reviewed_negatives(negatives: DataFrame, labels: DataFrame, drop: tuple[str, ...] = ("POSSIBLE_LEAK",)) -> DataFrame:
    """human_verified and human_label set from (neg_id, human_label), dropped labels removed."""
    new = labels.select("neg_id", F.upper(strip("human_label")).alias("_label")).where("_label is not null and _label <> ''").dropDuplicates(["neg_id"])
    out = negatives.join(new, "neg_id", "left")
    out = out.withColumns({"human_verified": F.coalesce("human_verified", F.lit(False)) | F.col("_label").isNotNull(), "human_label": F.coalesce("_label", "human_label")})
    return out.where(F.coalesce(~F.col("_label").isin(*drop), F.lit(True))).drop("_label")


def missing_ids(labels: DataFrame, rows: DataFrame, id_: str) -> DataFrame:
    return labels.select(id_).distinct().join(rows.select(id_), id_, "left_anti")


def pruned(pairs: DataFrame, changed: DataFrame, anchor: str, anchor_id: str) -> DataFrame:
    """Pairs without those whose anchor was changed."""
    return pairs.join(changed.select(F.col(anchor_id).alias(anchor)).distinct(), anchor, "left_anti")


def pass_rate(negatives: DataFrame, ok: Column) -> DataFrame:
    """One row (n_reviewed, n_ok, rate), the rate null where nothing is reviewed."""
    r = negatives.where("human_label is not null").agg(F.count("*").alias("n_reviewed"), F.count_if(ok).alias("n_ok"))
    return r.withColumn("rate", F.try_divide("n_ok", "n_reviewed"))


# ---------------------------------------------------------------- templates, audits, corpus decisions

# Decisions about corpus rows, labels of reviewed negatives.
CORPUS_DECISIONS = ("keep", "drop", "edit")
NEGATIVE_LABELS = ("NOT_SCIENCE_TALK", "POSSIBLE_LEAK", "UNCLEAR")


def template(rows: DataFrame, strata: list[str], id_: str, blanks: list[str], n: int = 50, seed: int = 42) -> DataFrame:
    """A stratified sample of n rows with blank columns to fill in."""
    from .sampling import stratified_sample

    return stratified_sample(rows, strata, id_, n, seed).withColumns({c: F.lit(None).cast("string") for c in blanks})


def ordered_columns(df: DataFrame, first: list[str], content: list[str], fill: list[str], internal: list[str]) -> DataFrame:
    """The columns in the order id, content, to fill in, internal, the rest; names that are not there are left out."""
    named = [c for c in dict.fromkeys([*first, *content, *fill]) if c in df.columns]
    last = [c for c in internal if c in df.columns and c not in named]
    return df.select(*named, *last, *[c for c in df.columns if c not in named and c not in last])


def label_problems(labels: DataFrame) -> DataFrame:
    """(neg_id, problem) of filled labels that are none of the known ones; blank ones are no problem."""
    label = F.upper(blank_to_null("human_label"))
    return labels.where(label.isNotNull() & ~label.isin(*NEGATIVE_LABELS)).select("neg_id", F.lit("unknown label").alias("problem"))


def not_science(corpus: DataFrame) -> DataFrame:
    """The corpus rows whose sub-types hold the sentinel, with the sub-types joined and blank decision columns."""
    from ..functions.arrays import SENTINEL

    rows = corpus.where(F.array_contains("subtype", SENTINEL))
    keep = [c for c in ("utt_id", "utterance", "setting", "source", "transcript_ref") if c in corpus.columns]
    return rows.select(*keep, F.array_join("subtype", ", ").alias("current_subtype"), *[F.lit(None).cast("string").alias(c) for c in ("decision", "corrected_text", "notes")])


def corpus_decision_problems(decisions: DataFrame) -> DataFrame:
    """(utt_id, problem): unknown decisions and edits without text; a blank decision keeps the row."""
    d = F.lower(blank_to_null("decision"))
    bad = F.array_compact(F.array(F.when(~d.isin(*CORPUS_DECISIONS), "unknown decision"), F.when((d == "edit") & blank_to_null("corrected_text").isNull(), "no corrected text")))
    return decisions.select("utt_id", F.explode(bad).alias("problem"))


def corpus_decided(corpus: DataFrame, decisions: DataFrame) -> DataFrame:
    """The corpus without dropped rows and with edited texts, by (utt_id, decision, corrected_text), one per id."""
    d = decisions.select("utt_id", F.lower(blank_to_null("decision")).alias("_d"), blank_to_null("corrected_text").alias("_t")).dropDuplicates(["utt_id"])
    rows = corpus.join(d, "utt_id", "left").where(F.coalesce(F.col("_d") != "drop", F.lit(True)))
    return rows.withColumn("utterance", F.when(F.col("_d") == "edit", F.col("_t")).otherwise(F.col("utterance"))).drop("_d", "_t")


def changed_anchors(decisions: DataFrame) -> DataFrame:
    """(utt_id) of the rows that are dropped or edited, whose variants no longer hold."""
    return decisions.where(F.lower(blank_to_null("decision")).isin("drop", "edit")).select("utt_id").distinct()


def routing_sample(routed: DataFrame, anchors: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    """(id, kind, text, anchor_text, routing, confidence, human_routing): n rows by kind and routing for an audit.

    ``routed`` has (id, kind, text, anchor_id, seed_term, routing, confidence); the anchor is shown by its text, else
    the seed term, else as '<no anchor>'.
    """
    from .sampling import stratified_sample

    drawn = stratified_sample(routed.where("routing is not null"), ["kind", "routing"], "id", n, seed)
    texts = anchors.select(F.col("utt_id").alias("anchor_id"), F.col("utterance").alias("_text"))
    shown = F.coalesce("_text", "seed_term", F.lit("<no anchor>"))
    return drawn.join(texts, "anchor_id", "left").select("id", "kind", "text", shown.alias("anchor_text"), "routing", "confidence", F.lit(None).cast("string").alias("human_routing"))


def refreshed(audit: DataFrame, routed: DataFrame, columns: tuple[str, ...] = ("routing", "confidence")) -> DataFrame:
    """The audit with the present values of ``columns``; ids that are no longer routed get nulls."""
    return audit.drop(*columns).join(routed.select("id", *columns).dropDuplicates(["id"]), "id", "left")


def audit_result(audit: DataFrame, target: float = 0.80) -> DataFrame:
    """(kind, routing, n, agreement, met) by grouping sets over filled audits (kind, routing, human_routing)."""
    from ..functions.text import routing_label
    from .metrics import agreement

    rows = audit.withColumns({"routing": routing_label("routing"), "_human": routing_label("human_routing")}).where("routing is not null and _human is not null")
    return agreement(rows, F.col("_human") == F.col("routing")).withColumn("met", F.col("agreement") >= target)


def disagreements(audit: DataFrame) -> DataFrame:
    """(routing, human_routing, n): the confusion of routings where both are given."""
    from ..functions.text import routing_label

    rows = audit.select(routing_label("routing").alias("routing"), routing_label("human_routing").alias("human_routing")).where("routing is not null and human_routing is not null")
    return rows.groupBy("routing", "human_routing").agg(F.count("*").alias("n"))
