"""One function per pipeline step over a folder of Parquet tables, and the command line that runs them.

A step reads its tables, applies operators and replaces its outputs by stage-and-rename, so it can be run again.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import arrays as A, scores as S, text as T
from ..operators import augment, budget, evaluation, labelling, metrics, mining, relate, retrieval, review, sampling
from ..operators.encoders import encoded, hashing
from ..sources.files import replace_table, scored_segments, write_by_folder
from . import reports, schemas
from .config import load_config
from .runtime import session, ship


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    try:
        df = spark.read.parquet(f"{folder}/{table}.parquet")
    except Exception as e:  # noqa: BLE001 - a table that isn't there is an empty one
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return schemas.empty(spark, table)
    return schemas.conformed(df, table) if table in schemas.TABLES else df


def _write(df: DataFrame, folder: str, table: str, backup: bool = False) -> str:
    return replace_table(df, f"{folder}/{table}.parquet", backup)


def clean(spark: SparkSession, folder: str, raw: DataFrame) -> str:
    """Raw rows (Utterance, Label, Setting, Source, cues, Notes, Citation) to the corpus table."""
    rows = raw.select(
        T.nfkc("utterance").alias("utterance"), "label", T.setting_of("setting").alias("setting"), T.topic_of("setting").alias("topic"), "source", T.cue_list("tier2").alias("tier2_cues"),
        T.cue_list("tier3").alias("tier3_cues"), T.mentions_coding("notes").alias("was_sci_coded"), T.transcript_ref("notes").alias("transcript_ref"), "citation", "row_no").where("utterance is not null")
    out = relate.numbered(relate.keep_first(rows, ["utterance"], ["row_no"]), ["row_no"], "utt_id", "utt_%04d")
    return _write(schemas.conformed(out, "corpus"), folder, "corpus")


def ingest(spark: SparkSession, folder: str, path: str, sheets: dict[str, str] | None = None) -> dict[str, str]:
    """The three sheets of the curated workbook to the tables corpus, seed_words and category_defs."""
    from .ingest import curated

    raw = curated(spark, path, sheets)
    out = {"corpus": clean(spark, folder, raw["corpus"])}
    for t in ("seed_words", "category_defs"):
        out[t] = _write(schemas.conformed(raw[t], t), folder, t)
    return out


def merge_mined(spark: SparkSession, folder: str, turns: DataFrame, dry_run: bool = False) -> dict[str, int]:
    """Coded teacher turns (sheet, row_no, speaker, utterance, code) that the corpus lacks, labelled and appended, with a
    backup; running it again adds nothing. Gives the counts; a dry run writes nothing."""
    corpus = _read(spark, folder, "corpus")
    found = mining.teacher_positives(turns, "speaker", "utterance", "code").withColumn("utterance", T.nfkc("utterance"))
    new = mining.mined(found, "utterance", ["sheet", "row_no"], corpus, "utterance")
    totals = evaluation.mined_totals(found, T.canon("utterance"), corpus, T.canon("utterance")).first().asDict()
    if dry_run:
        return totals | {"added": 0}
    start = relate.next_number(corpus, "utt_id", "utt_sci_").first()[0]
    rows = mining.as_corpus(new, "utterance", "sheet", ["sheet", "row_no"], start)
    index = labelling.seed_index(_read(spark, folder, "seed_words"))
    labels = labelling.cascade(rows, "utt_id", "utterance", None, None, index).withColumnRenamed("id", "utt_id")
    rows = relate.updated(rows, labels, "utt_id", ["subtype", "subtype_source", "subtype_confidence"])
    added = rows.count()
    if added:
        _write(corpus.unionByName(schemas.conformed(rows, "corpus")), folder, "corpus", backup=True)
    return totals | {"added": added}


def negative_subtypes(spark: SparkSession, folder: str, scan: bool = False, model=None) -> str:
    """Sub-types of negatives: no cues, the keyword scan if asked, else the model."""
    n = _read(spark, folder, "negatives")
    index = labelling.seed_index(_read(spark, folder, "seed_words"))
    made = labelling.cascade(n, "neg_id", "text", None, None, index, scan, model).withColumnRenamed("id", "neg_id")
    return _write(relate.updated(n, made, "neg_id", ["subtype", "subtype_source", "subtype_confidence"]), folder, "negatives")


def gate(spark: SparkSession, folder: str, call, only_generated: bool = True) -> str:
    """llm_gate_score of the generated negatives (or all): ``call`` maps a prompt to an answer, once per distinct prompt;
    an answer without a number, or an error, is null."""
    from ..functions import responses as R
    from ..operators import prompts

    n = _read(spark, folder, "negatives")
    todo = F.col("source_type").isin(*S.GENERATED) if only_generated else F.lit(True)
    asked = n.select("neg_id", F.when(todo, prompts.gate_prompt("text")).alias("_p"))
    scored = augment.generated(asked, "_p", call).select("neg_id", R.gate_response(F.col("response")).alias("llm_gate_score"))
    return _write(schemas.conformed(relate.updated(n, scored, "neg_id", ["llm_gate_score"]), "negatives"), folder, "negatives", backup=True)


def baseline_cosine(spark: SparkSession, folder: str, make=None) -> str:
    """(id, kind, baseline_cosine): of anchor and variant for pairs, of anchor and text for negatives with an anchor (0 where
    the anchor is unknown), null for the others; every distinct text is encoded once."""
    p, n, c = _read(spark, folder, "pairs"), _read(spark, folder, "negatives"), _read(spark, folder, "corpus")
    anchors = c.select(F.col("utt_id").alias("anchor_utt_id"), F.col("utterance").alias("a")).dropDuplicates(["anchor_utt_id"])
    rows = p.select(F.col("pair_id").alias("id"), F.lit("pair").alias("kind"), F.col("anchor_text").alias("a"), F.col("variant_text").alias("b"), F.lit(True).alias("has"))
    rows = rows.unionByName(n.join(anchors, "anchor_utt_id", "left").select(F.col("neg_id").alias("id"), F.lit("negative").alias("kind"), "a", F.col("text").alias("b"), F.col("anchor_utt_id").isNotNull().alias("has")))
    rows = rows.withColumns({c: T.embedding_text(c) for c in ("a", "b")})
    vectors = encoded(rows.select(F.col("a").alias("t")).union(rows.select("b")).distinct(), "t", make or hashing(64))
    both = rows.join(vectors.withColumnRenamed("vector", "va"), F.col("a") == F.col("t")).drop("t").join(vectors.withColumnRenamed("vector", "vb"), F.col("b") == F.col("t"))
    return _write(both.select("id", "kind", F.when(F.col("has"), S.cosine(F.col("va"), F.col("vb"))).alias("baseline_cosine")), folder, "baseline_cosine")


def subtypes(spark: SparkSession, folder: str, model=None) -> str:
    corpus = _read(spark, folder, "corpus")
    index = labelling.seed_index(_read(spark, folder, "seed_words"))
    made = labelling.cascade(corpus, "utt_id", "utterance", "tier2_cues", "tier3_cues", index, model=model).withColumnRenamed("id", "utt_id")
    return _write(relate.updated(corpus, made, "utt_id", ["subtype", "subtype_source", "subtype_confidence"]), folder, "corpus")


def negatives(spark: SparkSession, folder: str, transcripts: DataFrame | None = None, per_positive: int = 2) -> str:
    """Everyday sentences per positive and per seed term, teacher turns of coded transcripts, united and checked."""
    corpus = _read(spark, folder, "corpus").where("label = 'SCIENCE_TALK'")
    number = F.explode(F.sequence(F.lit(1), F.lit(per_positive)))
    hard = corpus.withColumn("k", number).select(augment.stub_negative(F.col("utterance"), F.col("k")).alias("text"), F.lit("llm_hard_negative").alias("source_type"), F.col("utt_id").alias("anchor_utt_id"), F.concat_ws("#", "utt_id", "k").alias("o"))
    seeds = _read(spark, folder, "seed_words").withColumn("k", number)
    term = seeds.select(F.concat(F.regexp_replace(augment.stub_negative(F.col("term"), F.col("k")), r"[. ]+$", ""), F.lit(", "), F.col("term"), F.lit(".")).alias("text"), F.lit("seed_word_nonscience").alias("source_type"), F.col("term").alias("anchor_seed_term"), F.concat_ws("#", "term", "k").alias("o"))
    parts = [(0, hard), (1, term)]
    if transcripts is not None:
        t = mining.teacher_negatives(transcripts, "speaker", "utterance", "code", "behaviour")
        parts.append((2, t.select(F.col("utterance").alias("text"), F.lit("transcript_clean").alias("source_type"), "transcript_subtype", F.col("code").alias("transcript_code"), F.concat("sheet", F.lit("!R"), "row_no").alias("transcript_ref"), F.concat_ws("#", "sheet", F.lpad(F.col("row_no").cast("string"), 9, "0")).alias("o"))))
    rows = mining.pool(parts, "text", "o", corpus, "utterance", None).withColumn("structural_check_passed", F.lit(True))
    out = relate.numbered(rows, ["source_type", "o"], "neg_id", "neg_%05d").withColumn("human_verified", F.lit(False))
    return _write(schemas.conformed(out, "negatives"), folder, "negatives")


def pairs(spark: SparkSession, folder: str) -> str:
    corpus = _read(spark, folder, "corpus").where("label = 'SCIENCE_TALK'")
    rows = augment.variant_pairs(corpus, "utt_id", "utterance", "setting", "tier2_cues", "tier3_cues")
    out = relate.numbered(rows, ["anchor_id", "register", "variant_no"], "pair_id", "pair_%05d").withColumn("llm_self_score", F.lit(0.7))
    return _write(schemas.conformed(out, "pairs"), folder, "pairs")


def routing(spark: SparkSession, folder: str) -> str:
    """(id, kind, confidence, routing) of pairs and negatives by their baseline cosine; a row without one is neutral."""
    p, n = _read(spark, folder, "pairs"), _read(spark, folder, "negatives")
    try:
        cosines = spark.read.parquet(f"{folder}/baseline_cosine.parquet")
    except Exception as e:  # noqa: BLE001 - routing may run before any encoder did
        if "PATH_NOT_FOUND" not in str(e):
            raise
        cosines = spark.createDataFrame([], "id string, kind string, baseline_cosine double")
    a = p.select(F.col("pair_id").alias("id"), F.lit("pair").alias("kind"), "llm_self_score", "differs_from_anchor").join(cosines, ["id", "kind"], "left")
    a = a.select("id", "kind", S.pair_confidence(F.col("llm_self_score"), F.col("baseline_cosine"), F.col("differs_from_anchor")).alias("confidence"))
    b = n.select(F.col("neg_id").alias("id"), F.lit("negative").alias("kind"), "source_type", "llm_gate_score", "structural_check_passed").join(cosines, ["id", "kind"], "left")
    b = b.select("id", "kind", S.negative_confidence(F.col("source_type"), F.col("llm_gate_score"), F.col("baseline_cosine"), F.col("structural_check_passed")).alias("confidence"))
    return _write(a.unionByName(b).withColumn("routing", S.route(F.col("confidence"))), folder, "routing")


def audit(spark: SparkSession, folder: str, filled: DataFrame, target: float | None = None) -> DataFrame:
    """(kind, routing, n, agreement, met) of a filled audit (id, kind, human_routing) against the present routing."""
    now = review.refreshed(filled, spark.read.parquet(f"{folder}/routing.parquet"))
    return review.audit_result(now, load_config(part="audit")["agreement_target"] if target is None else target)


def review_negatives(spark: SparkSession, folder: str, labels: DataFrame, drop_unclear: bool = False) -> dict[str, int]:
    """Reviewed labels (neg_id, human_label) onto the negatives, leaks dropped, with a backup; unknown labels raise."""
    if n := review.label_problems(labels).count():
        raise ValueError(f"{n} unknown labels")
    rows = _read(spark, folder, "negatives")
    before, missing = rows.count(), review.missing_ids(labels, rows, "neg_id").count()
    _write(schemas.conformed(review.reviewed_negatives(rows, labels, ("POSSIBLE_LEAK", "UNCLEAR") if drop_unclear else ("POSSIBLE_LEAK",)), "negatives"), folder, "negatives", backup=True)
    return {"before": before, "after": _read(spark, folder, "negatives").count(), "missing": missing}


def review_corpus(spark: SparkSession, folder: str, decisions: DataFrame) -> dict[str, int]:
    """Decisions (utt_id, decision, corrected_text) on corpus rows: dropped, edited, and the pairs of both pruned."""
    if n := review.corpus_decision_problems(decisions).count():
        raise ValueError(f"{n} malformed decisions")
    corpus, p = _read(spark, folder, "corpus"), _read(spark, folder, "pairs")
    sizes = corpus.count(), p.count()
    _write(schemas.conformed(review.corpus_decided(corpus, decisions), "corpus"), folder, "corpus", backup=True)
    _write(review.pruned(p, review.changed_anchors(decisions), "anchor_id", "utt_id"), folder, "pairs", backup=True)
    return {"corpus_before": sizes[0], "corpus_after": _read(spark, folder, "corpus").count(), "pairs_before": sizes[1], "pairs_after": _read(spark, folder, "pairs").count()}


def queue(spark: SparkSession, folder: str) -> str:
    return _write(review.queue(_read(spark, folder, "routing").select("id", "kind", "routing"), _read(spark, folder, "review_decisions")), folder, "review_queue")


def decide(spark: SparkSession, folder: str, decisions: DataFrame) -> str:
    """Valid decisions appended to the decision table, the newest per id kept; raises where a decision is malformed."""
    bad = review.problems(decisions)
    if n := bad.count():
        raise ValueError(f"{n} malformed decisions, such as {[tuple(r) for r in bad.limit(5).collect()]}")
    known = _read(spark, folder, "review_decisions")
    return _write(review.latest(known.unionByName(schemas.conformed(review.decided(decisions), "review_decisions"))), folder, "review_decisions")


def splits(spark: SparkSession, folder: str) -> str:
    """Verified rows, held-out informal families, stratified splits of the rest."""
    cfg = load_config(part="splits")
    corpus = _read(spark, folder, "corpus")
    held = _read(spark, folder, "review_decisions")
    p = review.verified(review.applied(_read(spark, folder, "pairs"), "pair_id", held), "variant_text")
    n = review.verified(review.applied(_read(spark, folder, "negatives"), "neg_id", held), "text")
    slice_ = sampling.held_out_families(corpus.select(F.col("utt_id").alias("id"), "setting"), F.col("setting").isin(*T.INFORMAL_SETTINGS), p.where("register = 'INFORMAL'").select("anchor_id"), cfg["informal_variant_families"], cfg["seed"])
    _write(slice_, folder, "hard_informal_slice")
    kept = corpus.join(slice_.select(F.col("id").alias("utt_id")), "utt_id", "left_anti").select(F.col("utt_id").alias("id"), A.first_subtype("subtype").alias("stratify_key"))
    free = p.join(slice_.select(F.col("id").alias("anchor_id")), "anchor_id", "left_anti").select(F.col("pair_id").alias("id"), "anchor_id", F.concat(F.lit("pair::"), "register").alias("stratify_key"))
    neg = n.select(F.col("neg_id").alias("id"), F.concat_ws("::", "source_type", A.first_subtype("subtype")).alias("stratify_key"))
    return _write(sampling.make_splits(kept, neg, free, tuple(cfg["ratios"]), cfg["seed"]), folder, "splits")


def embed(spark: SparkSession, folder: str, make=None) -> str:
    """(id, v) of the positives; ``make`` builds an encoder, a hashing stand-in by default."""
    corpus = _read(spark, folder, "corpus").where("label = 'SCIENCE_TALK'")
    rows = retrieval.scored_once(corpus.select("utt_id", "utterance"), "utterance", lambda t: encoded(t, "_text", make or hashing(64), "search_document: "))
    return _write(rows.select(F.col("utt_id").alias("id"), F.col("vector").alias("v")), folder, "corpus_embeddings")


def evaluate(spark: SparkSession, folder: str, make=None) -> DataFrame:
    """(system, threshold, f1, recall, slice_recall, n, test_precision, test_recall, test_f1): each phrase's best anchor by
    cosine and by the pair scorer; thresholds are tuned on val and the slice, and applied once to test."""
    cfg = load_config(part="eval")
    corpus = _read(spark, folder, "corpus").where("label = 'SCIENCE_TALK'").select(F.col("utt_id").alias("match_id"), "utterance")
    phrases = _read(spark, folder, "pairs").select(F.col("pair_id").alias("id"), "anchor_id", F.col("variant_text").alias("phrase"), F.lit(True).alias("truth"))
    phrases = phrases.unionByName(_read(spark, folder, "negatives").select(F.col("neg_id").alias("id"), F.lit(None).cast("string").alias("anchor_id"), F.col("text").alias("phrase"), F.lit(False).alias("truth")))
    vectors = retrieval.scored_once(phrases, "phrase", lambda t: encoded(t, "_text", make or hashing(64), "search_query: "))
    found = retrieval.best_match(vectors.select("id", F.col("vector").alias("v")).where("v is not null"), spark.read.parquet(f"{folder}/corpus_embeddings.parquet"))
    scored = phrases.join(found, "id").join(corpus, "match_id").join(_read(spark, folder, "splits").select("id", "split"), "id", "left")
    held = spark.read.parquet(f"{folder}/hard_informal_slice.parquet").select(F.col("id").alias("anchor_id"), F.lit(True).alias("in_slice"))
    scored = scored.join(held, "anchor_id", "left").withColumn("pair_score", A.jaccard("phrase", "utterance"))
    out = None
    for system, score in (("cosine", "similarity"), ("rerank", "pair_score")):
        rows = scored.withColumn("score", F.col(score))
        best = metrics.tune_threshold(rows.where("split = 'val'"), rows.where("in_slice"), metrics.threshold_grid(**cfg["threshold_grid"]), cfg["hard_informal_recall_floor"])
        test = metrics.confusion(rows.where("split = 'test'").crossJoin(F.broadcast(best.select("threshold"))), F.col("truth"), F.col("score") >= F.col("threshold"))  # one row
        line = best.crossJoin(test).select(F.lit(system).alias("system"), "threshold", best["f1"], best["recall"], "slice_recall", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"),
                                           test["precision"].alias("test_precision"), test["recall"].alias("test_recall"), test["f1"].alias("test_f1"))
        out = line if out is None else out.unionByName(line)
    return out


def deploy(spark: SparkSession, folder: str, cells: DataFrame, output: str, make=None, llm=None, cached: DataFrame | None = None, overwrite: bool = False, science_only: bool = False) -> DataFrame:
    """Transcript cells (folder, file, line_no, cell, speaker) scored under the call cap with carry-over between folders.

    One directory per folder and file is written; folders whose directory is there are not scored again. ``cached`` has
    the (utterance) that need no new calls. Gives (folder, rows, science, allowed, calls); a manifest is written beside.
    """
    cfg = load_config(part="deploy")
    done = frozenset() if overwrite else _finished(spark, output)
    folders = cells.select("file", "folder").distinct()
    rows = scored_segments(cells, tuple(cfg["speakers"]), cfg["min_confidence"]).withColumn("id", F.concat_ws("#", "file", "line_no")).join(folders, "file")
    vectors = retrieval.scored_once(rows, "utterance", lambda t: encoded(t, "_text", make or hashing(64), "search_query: "))
    found = retrieval.best_match(vectors.select("id", F.col("vector").alias("v")).where("v is not null"), spark.read.parquet(f"{folder}/corpus_embeddings.parquet"))
    anchors = _read(spark, folder, "corpus").select(F.col("utt_id").alias("match_id"), A.joined_subtypes("subtype").alias("match_subtype")).dropDuplicates(["match_id"])
    found = rows.join(found, "id").join(anchors, "match_id", "left")
    free = cached.select("utterance", F.lit(True).alias("_free")).distinct() if cached is not None else spark.createDataFrame([], "utterance string, _free boolean")
    found = found.join(free, "utterance", "left")
    taken = budget.spend_rolling(found, "folder", F.col("similarity"), F.col("_free"), "id", cfg["top_k"], cfg["dollar_cap"], cfg["cost_per_call"], done)
    taken = taken.join(llm(taken.where("taken").select("id", "utterance", "match_id")), "id", "left") if llm else taken.withColumn("llm_score", F.lit(None).cast("double"))
    how = F.when(F.col("taken") & F.col("llm_score").isNotNull(), "llm").otherwise("cosine")
    args = how, F.col("llm_score"), F.col("similarity")
    scored = taken.select("folder", "file", "line_no", "child_id", "speaker", "utterance", "confidence", F.col("similarity").alias("cosine_score"), "match_id", "match_subtype", "llm_score", how.alias("scored_by"), "taken", "_free", "allowed",
                          S.two_threshold_label(*args, cfg["llm_label_threshold"], cfg["cosine_label_threshold"]).alias("predicted_label"), S.two_threshold_score(*args).alias("score"))
    from .runtime import written

    scored = written(scored, "scored")
    shown = scored.where("predicted_label = 'SCIENCE_TALK'") if science_only else scored
    write_by_folder(shown.drop("taken", "_free", "allowed"), output, "folder", "file", ["line_no"])
    calls = F.count_if(F.col("taken") & F.col("_free").isNull()) * cfg["top_k"]
    by = scored.groupBy("folder").agg(F.count("*").alias("rows"), F.count_if(F.col("predicted_label") == "SCIENCE_TALK").alias("science"), F.max("allowed").alias("allowed"), calls.alias("calls"))
    states = [r.asDict() | {"done": True} for r in by.orderBy("folder").collect()]  # one row per folder
    reports.write_text(spark, f"{output}/_manifest.json", reports.manifest(states, cfg["dollar_cap"], cfg["cost_per_call"]))
    return by


def _finished(spark: SparkSession, output: str) -> frozenset[str]:
    """The folders that have an output directory."""
    p = spark._jvm.org.apache.hadoop.fs.Path(output)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return frozenset(n.removeprefix("folder=") for n in names if n.startswith("folder="))


def report(spark: SparkSession, folder: str, make=None) -> str:
    """The evaluation of the systems as Markdown, written to the folder."""
    text = reports.markdown(evaluate(spark, folder, make), "Systems on the test split")
    reports.write_text(spark, f"{folder}/evaluation.md", text)
    return text


def rebuild(spark: SparkSession, folder: str) -> None:
    """Everything after a change of the corpus: labels, pairs, negatives, cosines, routing, splits, embeddings."""
    for step in (subtypes, negatives, pairs, baseline_cosine, routing, queue, splits, embed):
        step(spark, folder)


STEPS = {"subtypes": subtypes, "negatives": negatives, "negative_subtypes": negative_subtypes, "pairs": pairs, "baseline_cosine": baseline_cosine, "routing": routing, "queue": queue, "splits": splits, "embed": embed, "report": report}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m talkengine.plans.jobs", description=__doc__)
    parser.add_argument("folder", help="folder of the Parquet tables")
    parser.add_argument("--steps", nargs="+", choices=list(STEPS), default=list(STEPS))
    parser.add_argument("--workbook", help="curated workbook to take the tables from first")
    parser.add_argument("--mine", help="coded workbook whose science turns are added to the corpus first")
    parser.add_argument("--dry-run", action="store_true", help="with --mine, only count")
    given = parser.parse_args(args)
    spark = SparkSession.getActiveSession() or session()
    ship(spark)
    if given.workbook:
        print(ingest(spark, given.folder, given.workbook), flush=True)
    if given.mine:
        from .ingest import coded_turns

        print(merge_mined(spark, given.folder, coded_turns(spark, given.mine), given.dry_run), flush=True)
        if given.dry_run:
            return
    for step in given.steps:
        STEPS[step](spark, given.folder)
        print(f"{step}: done", flush=True)


if __name__ == "__main__":
    main()
