"""Operators of the core against hand-computed values, and every query against its SQL on the small tables."""

import math
import zipfile
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from talkengine.functions import arrays as A, responses as R, scores as S, text as T
from talkengine.operators import augment, budget, evaluation, labelling, metrics, mining, pipeline, prompts, relate, requests, retrieval, review, sampling
from talkengine.plans import catalogue, ingest, jobs, reports, schemas
from talkengine.sources import files, xlsx

DATA = Path("/root/testdata/sf0.001")


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, x {kind}")
    return [r[0] for r in df.orderBy("k").select(column).collect()]


def close(a, b):
    return a == b or isinstance(a, (int, float)) and isinstance(b, (int, float)) and math.isclose(a, b, abs_tol=1e-6)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    rows = df.collect()
    if name not in catalogue.SQL:
        ids = [r[df.columns[0]] for r in rows]  # one row per record of the table, none twice
        table = {"mapinpandas_encoder": ("corpus", "utt_id"), "incremental_scoring_stream": ("pairs", "pair_id")}[name]
        assert sorted(ids) == sorted(r[0] for r in spark.read.parquet(f"{DATA}/{table[0]}.parquet").select(table[1]).distinct().collect())
        return
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    got = con.execute(catalogue.SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    flat = lambda r, cols: tuple(round(v, 6) if isinstance(v, float) else v for v in cols(r))
    a = sorted((flat(r, lambda r: [r[c] for c in sorted(columns)]) for r in rows), key=repr)
    b = sorted((flat(r, lambda r: [r[columns.index(c)] for c in sorted(columns)]) for r in got.fetchall()), key=repr)
    assert len(a) == len(b) and all(all(map(close, x, y)) for x, y in zip(a, b))


def test_text(spark):
    assert values(spark, T.squeeze("x"), ["  a \n b ", "", None]) == ["a b", "", None]
    assert values(spark, T.nfkc("x"), ["ｆｕｌｌ  x", None]) == ["full x", None] and values(spark, T.casefolded("x"), ["Straße", None]) == ["strasse", ""]
    assert values(spark, T.cue_list("x"), ["a| b;,c", " ", None]) == [["a", "b", "c"], [], []]
    assert values(spark, T.setting_of("x"), ["Centers / Water / Ice", "Gym", None, "Blocks/Engineering"]) == ["Centers", "Unknown", "Unknown", "Blocks/Engineering"]
    assert values(spark, T.topic_of("x"), ["Centers / Water / Ice", "Centers"]) == ["Water / Ice", None]
    assert values(spark, T.transcript_ref("x"), ["see (01-2_19LG #91, x)", "none", None]) == ["01-2_19LG #91", None, None]
    assert values(spark, T.mentions_coding("x"), ["was sci-CODED", "no", None]) == [1, 0, 0]
    assert values(spark, T.sheet_setting("x"), ["01-2_19LG", "8-15C", "15LG2", "TOC"]) == ["Large Group", "Centers", "Large Group", "Unknown"]
    assert values(spark, T.register_of("x"), ["Centers ", "Transition", None]) == ["INFORMAL", None, None]
    assert values(spark, F.round(T.confidence_of("x"), 6), ["hello (57.6%)", "hello", None]) == [0.576, None, None] and values(spark, T.spoken("x"), ["hello (57.6%)"]) == ["hello"]
    assert values(spark, T.child_of("x"), ["a-b-c-77_x.xlsx", "short.xlsx"]) == ["77", "base"]
    assert values(spark, T.is_fragment("x"), ["one two three four five six", "one two", None, "a b c d e"]) == [False, True, True, True]
    assert values(spark, T.well_formed("x", F.lit("ice")), ["the ice melts", "mice run", "ice", None]) == [True, False, False, False]
    assert values(spark, T.differs("x", F.lit("Look  here")), ["look here", "look there", "", None]) == [False, True, False, False]
    assert values(spark, T.is_teacher("x"), ["T1:", "T", " T7:", "C3:", "Tom"]) == [True, True, True, False, False]
    assert values(spark, T.blank_to_null("x"), [" a ", "nan", "", None]) == ["a", None, None, None]
    assert values(spark, T.routing_label("x"), [" Auto", "<NA>", None]) == ["auto", None, None]


def test_arrays(spark):
    assert values(spark, A.joined_subtypes("x"), [["b", "a"], [], None], "array<string>") == ["a|b", "unknown", "unknown"]
    assert values(spark, A.first_subtype("x"), [["b", "a"], None], "array<string>") == ["a", "unknown"]
    assert values(spark, A.kept_share(F.lit("The Ice melts"), F.col("x")), [["ice", "snow"], []], "array<string>") == [0.5, 1.0]
    assert values(spark, A.target_registers("x"), ["INFORMAL", None]) == [["LARGE_GROUP", "SMALL_GROUP"], ["LARGE_GROUP", "SMALL_GROUP", "INFORMAL"]]
    assert values(spark, A.jaccard("x", F.lit("a b c")), ["A b", "", None]) == [0.667, 0.0, 0.0]


def test_scores(spark):
    assert values(spark, S.band(F.col("x"), 0.4, 0.8, 0.2), [0.5, 0.4, 0.3, 0.1, 0.9, 1.2, None], "double") == pytest.approx([1, 1, 0.5, 0, 0.5, 0, 0.5])
    assert values(spark, S.geometric_mean([F.col("x"), F.lit(1.0)], [1, 1]), [0.25, 0.0], "double") == pytest.approx([0.5, math.sqrt(1e-3)])
    assert values(spark, S.route(F.col("x")), [0.7, 0.15, 0.1, None], "double") == ["auto", "spot", "review", None]
    assert values(spark, S.clamp01(F.col("x")), [2.0, -1.0, 0.3, None], "double") == [1.0, 0.0, 0.3, None]
    assert values(spark, S.cosine(F.col("x"), F.array(F.lit(1.0), F.lit(0.0))), [[2.0, 0.0], [0.0, 0.0], [0.0, 3.0]], "array<double>") == [1.0, 0.0, 0.0]
    assert values(spark, S.two_threshold_label(F.lit("llm"), F.col("x"), F.lit(0.5)), [0.9, 0.8, None], "double") == ["SCIENCE_TALK", "NOT_SCIENCE_TALK", "SCIENCE_TALK"]
    with pytest.raises(ValueError):
        S.geometric_mean([F.lit(1.0)], [0])


def test_responses(spark):
    labels, sure = R.subtype_response(F.col("x"))
    texts = ['{"subtypes": ["content", "prediction", "other"], "confidence": 3}', 'so {"subtypes": ["not_science_shape", "content"], "confidence": "0.4"} ok', "what", None]
    assert values(spark, labels, texts) == [["content", "prediction"], ["not_science_shape"], ["not_science_shape"], ["not_science_shape"]] and values(spark, sure, texts) == [1.0, 0.4, 0.0, 0.0]
    assert values(spark, R.negatives_response(F.col("x")), ['{"negatives": [" a ", ""]}', 'x {"a": 1} {"negatives": ["b"]}', "no", None]) == [["a"], ["b"], [], []]
    assert values(spark, R.gate_response(F.col("x")), ["0.85", "score: .5", "1", "none", None]) == [0.85, 0.5, 1.0, None, None]
    got = values(spark, R.variants_response(F.col("x")), ['{"variants": [{"text": "a", "self_score": 2}, "b", {"text": " "}]}', 'say {"variants": ["c"]}', "no"])
    assert [[tuple(v) for v in g] if g is not None else None for g in got] == [[("a", 1.0), ("b", None)], [("c", None)], None]
    score, why = R.score_response(F.col("x"))
    assert values(spark, score, ['ok {"score": 0.7, "rationale": "r"}', "<score>1.5</score>", "x"]) == [0.7, 1.0, None] and values(spark, why, ['{"score": 0.7, "rationale": "r"}']) == ["r"]
    assert values(spark, R.response_kind(F.col("x")), ["fine", "", '{"error": "quota exceeded"}', '{"error": "busy"}', None]) == ["ok", "transient", "quota_auth", "transient", "transient"]


def test_relate(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 3, "z"), (None, 4, None)], "k string, o int, v string")
    assert sorted(map(tuple, relate.keep_first(df, ["k"], ["o"]).collect()), key=repr) == [("a", 1, "y"), (None, 3, "z")]
    assert sorted(map(tuple, relate.keep_last(df, ["k"], ["o"]).collect()), key=repr) == [("a", 2, "x"), (None, 4, None)]
    new = relate.updated(df.select("k", "v"), spark.createDataFrame([("a", None, "n")], "k string, v string, w string"), "k", ["v", "w"])
    assert sorted(map(tuple, new.collect()), key=repr) == sorted([("a", None, "n"), ("a", None, "n"), (None, "z", None), (None, None, None)], key=repr)
    n = relate.numbered(spark.range(1000).selectExpr("999 - id as v"), ["v"], "id", "n_%04d", 5).orderBy("v").collect()
    assert [r["id"] for r in n] == [f"n_{k:04d}" for k in range(5, 1005)]
    assert relate.next_number(spark.createDataFrame([("u_07",), ("x",)], "i string"), "i", "u_").first()[0] == 8
    assert relate.next_number(spark.createDataFrame([], "i string"), "i", "u_").first()[0] == 0


def test_stratified_split_sizes(spark):
    df = spark.createDataFrame([(f"a{k}", "A") for k in range(100)] + [(f"b{k}", "B") for k in range(50)] + [("n", None)], "id string, key string")
    got = sampling.stratified_split(df, "key", "id", (0.6, 0.2, 0.2)).groupBy("key", "split").count().collect()
    by = {(r["key"], r["split"]): r["count"] for r in got}
    assert by[("A", "train")] == 60 and by[("A", "val")] == by[("A", "test")] == 20 and by[("B", "train")] == 30 and by[("B", "val")] == 10 and by[(None, "train")] == 1
    with pytest.raises(ValueError):
        sampling.stratified_split(df, "key", "id", (0.5, 0.2, 0.2))


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_results_do_not_depend_on_partitions(spark, partitions):
    df = spark.range(500).selectExpr("cast(id as string) as id", "cast(id % 3 as string) as key").repartition(partitions)
    rows = sorted(map(tuple, sampling.stratified_split(df, "key", "id").select("id", "split").collect()))
    assert rows == sorted(map(tuple, sampling.stratified_split(df.coalesce(1), "key", "id").select("id", "split").collect()))


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (0, 1), (1, 0), (0, 0)], "y int, p int")
    r = metrics.confusion(df, F.col("y") == 1, F.col("p") == 1).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (2, 1, 1, 1) and r["precision"] == r["recall"] == r["f1"] == pytest.approx(2 / 3)
    for rows, want in (([(1, 0.9), (1, 0.8), (0, 0.1)], 1.0), ([(1, 0.1), (0, 0.9)], 0.0), ([(1, 0.5), (0, 0.5)], 0.5), ([(1, 0.5)], None)):
        s = spark.createDataFrame(rows, "y int, s double")
        assert metrics.auroc(s, F.col("y") == 1, F.col("s")).first()["auroc"] == want
    for rows, want in (([(1.0, 2.0), (2.0, 4.0), (3.0, 9.0)], 1.0), ([(1.0, 3.0), (2.0, 1.0)], -1.0), ([(1.0, 1.0), (1.0, 2.0)], None), ([(1.0, 1.0)], None)):
        got = metrics.spearman(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()["spearman"]
        assert got == want or got == pytest.approx(want)
    assert metrics.threshold_grid(0, 1, 0.25) == [0, 0.25, 0.5, 0.75] and len(metrics.threshold_grid()) == 19
    dev = spark.createDataFrame([(0.9, True), (0.6, True), (0.55, False), (0.1, False)], "score double, truth boolean")
    best = metrics.tune_threshold(dev, spark.createDataFrame([(0.7,), (0.6,), (0.3,)], "score double"), [0.25, 0.5, 0.58, 0.75], 0.6).first()
    assert best["threshold"] == 0.58 and best["f1"] == 1.0
    ranked = spark.createDataFrame([("q1", 1, True), ("q1", 2, False), ("q2", 1, False), ("q2", 2, True), ("q3", 1, False)], "query_id string, rank int, relevant boolean")
    m = metrics.ranking_metrics(ranked, 1).first()
    assert m["n_queries"] == 2 and m["precision_at_1"] == 0.5 and m["mrr"] == 0.75 and m["mrr_at_k"] == 0.5 and m["recall_at_k"] == 0.5 and m["ndcg_at_k"] == 0.5


def test_retrieval_by_blocks(spark):
    import random

    r = random.Random(1)
    rows = []
    for k in range(60):
        v = [r.gauss(0, 1) for _ in range(8)]
        n = math.sqrt(sum(x * x for x in v))
        rows.append((k, [x / n for x in v]))
    bank = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    want = {q: [i for _, i in sorted((-round(sum(a * b for a, b in zip(v, w)), 6), i) for i, w in rows if i != q)[:4]] for q, v in rows}
    for block in (7, 1000):
        got = retrieval.top_k(bank, bank, 4, block).orderBy("query_id", "rank").collect()
        assert {q: [x["id"] for x in got if x["query_id"] == q] for q in want} == want
    assert retrieval.top_k(bank, bank.limit(0), 4).count() == 0
    c = spark.createDataFrame([(1, 5, 0.9, 1, None), (1, 6, 0.8, 2, 0.4), (2, 7, 0.6, 1, None)], "query_id int, id int, similarity double, rank int, llm double")
    out = {x["query_id"]: (x["score"], x["label"], x["degraded"]) for x in retrieval.reranked(c, F.col("llm"), 0.5, 0.5).collect()}
    assert out == {1: (0.4, "NOT_SCIENCE_TALK", False), 2: (0.6, "SCIENCE_TALK", True)}


def test_labelling_cascade(spark):
    seeds = spark.createDataFrame([("notice", "TIER2", "INQUIRY_VERB", ["notices"]), ("because", "TIER2", "REASONING_FRAME", []), ("magnet", "TIER3", "PROPERTIES_MATERIALS", ["magnets"]), ("what if", "TIER2", "INQUIRY_VERB", None)],
                                  "term string, tier string, category string, variants array<string>")
    rows = [("r", "x", ["because"], []), ("rk", "What if two magnets met?", ["notice"], None), ("k", "She notices it", None, None), ("m", "hello", [], []), ("o", "x", ["strange"], ["ice"]), ("z", None, None, None)]
    df = spark.createDataFrame(rows, "id string, t string, a array<string>, b array<string>")
    seen = []
    out = labelling.cascade(df, "id", "t", "a", "b", labelling.seed_index(seeds), model=lambda d: (seen.append({r["id"] for r in d.collect()}), d.select("id", A.strings("content").alias("subtype"), F.lit(0.5).alias("subtype_confidence")))[1])
    got = {r["id"]: (r["subtype"], r["subtype_source"], r["subtype_confidence"]) for r in out.collect()}
    assert got == {
        "r": (["causal_reasoning", "evidence"], "rule", 1.0), "rk": (["content", "observation", "prediction"], "rule+keyword", 1.0), "k": (["observation"], "keyword", 1.0),
        "o": (["content", "observation"], "rule", 1.0), "m": (["content"], "llm", 0.5), "z": (["content"], "llm", 0.5)}
    assert seen == [{"m", "z"}]


def test_mining(spark):
    rows = spark.createDataFrame([("S1", 1, "T1:", "We will see what the magnet does now", "SCI", None), ("S1", 2, "C3:", "I see it", "SCI", None), ("S1", 3, "T:", "Sit down right now please, all of you", None, "y"), ("S1", 4, "T", "  ", None, None), ("S1", 5, "T2", "we will see  what the magnet does NOW", "sci", None)],
                                 "sheet string, row_no int, speaker string, utterance string, code string, behaviour string")
    neg = mining.teacher_negatives(rows, "speaker", "utterance", "code", "behaviour").collect()
    assert [(r["row_no"], r["transcript_subtype"]) for r in neg] == [(3, "behavior_disapproving")]
    pos = mining.teacher_positives(rows, "speaker", "utterance", "code")
    assert [r["row_no"] for r in mining.distinct_utterances(pos, "utterance", ["row_no"]).collect()] == [1]
    known = spark.createDataFrame([("WE WILL SEE what the magnet does now",)], "u string")
    assert mining.mined(pos, "utterance", ["row_no"], known, "u").count() == 0 and mining.mined(pos, "utterance", ["row_no"], known.limit(0), "u").count() == 1
    docs = spark.createDataFrame([(1, "[00:01:02] T1: Hello there.\nno speaker here\nC2: Hi\n"), (2, None)], "d int, t string")
    assert [(r["line_no"], r["clock"], r["speaker"], r["utterance"]) for r in mining.turns(docs, "d", "t").orderBy("line_no").collect()] == [(1, "00:01:02", "T1", "Hello there."), (3, None, "C2", "Hi")]


def test_review(spark):
    kinds = "id string, kind string, decision string, reviewer string, decided_at timestamp_ntz, corrected_text string, reject_reason string, reject_notes string"
    import datetime as dt

    at = lambda k: dt.datetime(2025, 1, k)
    d = spark.createDataFrame([("a", "pair", "reject", "r", at(1), None, "nonsense", None), ("a", "pair", "edit", "r", at(2), "new", None, None), ("b", "pair", "accept", "r", at(1), None, None, None)], kinds)
    bad = spark.createDataFrame([("c", "pair", "maybe", None, None, None, None, None), ("d", "pair", "reject", None, None, None, "why", None), ("e", "pair", "edit", None, None, " ", None, None), ("f", "pair", None, None, None, None, None, None)], kinds)
    assert {r["id"] for r in review.problems(bad).collect()} == {"c", "d", "e"} and review.problems(d).count() == 0 and review.decided(bad).count() == 0
    last = review.latest(d)
    assert {r["id"]: r["decision"] for r in last.collect()} == {"a": "edit", "b": "accept"} and review.latest(last.unionByName(d)).count() == 2
    rows = spark.createDataFrame([("a", "old", "review"), ("b", "x", "review"), ("c", "y", None), ("e", "z", "auto"), ("f", "w", "spot")], "id string, t string, routing string")
    assert {r["id"]: r["t"] for r in review.verified(review.applied(rows, "id", d), "t").collect()} == {"a": "new", "b": "x", "c": "y", "e": "z"}


def test_budget(spark):
    assert budget.max_calls(0.3, 0.0001) == 3000
    df = spark.createDataFrame([("a", 0.9, 2), ("b", 0.9, 2), ("c", 0.5, 0), ("d", 0.4, 5), ("e", 0.3, 1)], "id string, s double, c int")
    took = lambda **k: {r["id"] for r in budget.spend(df, F.col("s"), F.col("c"), "id", **k).where("taken").collect()}
    assert took(allowed=4) == {"a", "b", "c"} and took(allowed=12, reserve=5) == {"a", "b", "c", "d"} and took(allowed=0) == set()


def test_variants(spark):
    df = spark.createDataFrame([("u", "Look at the ice", "Centers", ["look", "melt"], [])], "i string, t string, s string, a array<string>, b array<string>")
    got = {r["register"]: (r["variant_text"], r["preservation_pct"]) for r in augment.variant_pairs(df, "i", "t", "s", "a", "b").collect()}
    assert got == {"LARGE_GROUP": ("Friends, everyone listen -- Look at the ice (melt)", 1.0), "SMALL_GROUP": ("Hmm, look you two, Look at the ice (melt)", 1.0)}
    calls = augment.generated(spark.createDataFrame([("a",), ("a",), ("boom",), (None,)], "p string"), "p", lambda p: {"a": "A"}[p])
    assert sorted((r["p"] or "", r["response"]) for r in calls.collect()) == [("", None), ("a", "A"), ("a", "A"), ("boom", None)]


def _book(path):
    head = '<?xml version="1.0"?>'
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'{head}<workbook {ns}><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Skip" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"{head}<sst {ns}><si><t>Name</t></si><si><r><t>two </t></r><r><t>parts</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'{head}<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>7</v></c></row><row r="3"><c r="B3" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'{head}<worksheet {ns}><sheetData><row r="1"><c r="A1"><v>1</v></c></row></sheetData></worksheet>')


def _curated(path):
    def row(n, cells):
        return f'<row r="{n}">' + "".join(f'<c r="{chr(65 + k)}{n}" t="inlineStr"><is><t>{c}</t></is></c>' for k, c in enumerate(cells) if c is not None) + "</row>"

    sheets = {
        "Example utterances": [["Utterance", "Label", "Setting", "Source", "Tier2 cues", "Tier3 cues", "Notes", "Article citation"], ["Look at  the ice", "SCIENCE_TALK", "Centers / Ice", "curated", "look; see", None, "SCI-coded", None], ["Look at the ice", "SCIENCE_TALK", "Centers", "curated", None, None, None, None]],
        "Seed words": [["Term", "Tier", "Category", "Variants (optional)", "Curriculum_source", "Source_URL"], [" ice ", "TIER3", "PROPERTIES_MATERIALS", "ices, icy", "g", None]],
        "Category definitions": [["Label", "Type", "Definition (operational)", "Include if…", "Exclude if…", "Examples (teacher wording)"], ["content", "category", "what it is", None, None, None]],
    }
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in (1, 2, 3)) + "</Relationships>")
        for k, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {ns}><sheetData>" + "".join(row(n, r) for n, r in enumerate(rows, 1)) + "</sheetData></worksheet>")


def test_sources(spark, tmp_path):
    _book(tmp_path / "b.xlsx")
    spark.dataSource.register(xlsx.XlsxSource)
    rows = spark.read.format("xlsx").option("skip_sheets", "Skip").load(str(tmp_path / "b.xlsx"))
    assert [tuple(r) for r in xlsx.named(rows, {"a": 0, "b": 1, "c": 2}).orderBy("row_no").collect()] == [("One", 2, "two parts", None, "7"), ("One", 3, None, "in", None)]
    assert files.read_any(spark, str(tmp_path / "b.xlsx")).count() == 4
    (tmp_path / "t.txt").write_text("one\n\n two \n")
    assert [(r["line_no"], r["text"]) for r in files.transcript_lines(spark, str(tmp_path / "t.txt")).collect()] == [(1, "one"), (3, "two")]
    table = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(table)
    backup = files.replace_table(spark.read.parquet(table).selectExpr("id + 1 as id"), table, True)
    assert spark.read.parquet(table).agg(F.sum("id")).first()[0] == 6 and spark.read.parquet(backup).count() == 3
    cells = spark.createDataFrame([("a-b-c-9_x", 2, "hi (90.0%)", "Adult"), ("f", 3, "low (10%)", "adult"), ("f", 4, "unsure", "child"), ("f", 5, "-", "adult"), ("f", 6, "x (99%)", "tv")], "file string, line_no int, cell string, speaker string")
    assert {(r["line_no"], r["child_id"], r["confidence"]) for r in files.scored_segments(cells).collect()} == {(2, "9", 0.9), (4, "base", None)}


def test_cache(spark, tmp_path):
    asked = []

    def call(misses):
        asked.append(misses.count())
        return misses.select("key", F.concat(F.lit("r"), "key").alias("response"), F.when(F.col("key") == "bad", "transient").otherwise("ok").alias("kind"))

    path = str(tmp_path / "cache")
    requests = spark.createDataFrame([("a",), ("a",), ("b",), ("bad",)], "key string")
    cache = spark.createDataFrame([("b", "old")], "key string, response string")
    got = files.cached_responses(requests, "key", cache, call, path)
    assert sorted(tuple(r) for r in got.collect()) == [("a", "ra"), ("a", "ra"), ("b", "old"), ("bad", "rbad")] and asked == [2]
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [("a", "ra")]


def test_jobs(spark, tmp_path):
    folder = str(tmp_path)
    raw = spark.createDataFrame([("What do you notice about the ice?", "SCIENCE_TALK", "Centers / Ice", "curated", "notice", "ice", "SCI-coded (S #3)", None, 1), ("What do you  notice about the ice?", "SCIENCE_TALK", "Gym", "curated", None, None, None, None, 2), ("Please sit down now", "NOT_SCIENCE_TALK", None, "curated", None, None, None, None, 3)],
                                "utterance string, label string, setting string, source string, tier2 string, tier3 string, notes string, citation string, row_no int")
    jobs.clean(spark, folder, raw)
    spark.createDataFrame([("notice", "TIER2", "INQUIRY_VERB", [], "g", None)], schemas.TABLES["seed_words"]).write.parquet(f"{folder}/seed_words.parquet")
    jobs.main([folder])
    corpus = {r["utt_id"]: r for r in spark.read.parquet(f"{folder}/corpus.parquet").collect()}
    assert set(corpus) == {"utt_0000", "utt_0001"} and corpus["utt_0000"]["subtype"] == ["content", "observation"] and corpus["utt_0000"]["topic"] == "Ice"
    for t in ("negatives", "pairs", "routing", "review_queue", "splits", "corpus_embeddings"):
        assert spark.read.parquet(f"{folder}/{t}.parquet").count() > 0
    assert schemas.corpus_problems(spark.read.parquet(f"{folder}/corpus.parquet"))
    jobs.main([folder, "--steps", "subtypes", "splits"])
    systems = {r["system"]: r for r in jobs.evaluate(spark, folder).collect()}
    assert set(systems) == {"cosine", "rerank"} and all(r["threshold"] is not None for r in systems.values())
    cells = spark.createDataFrame([("f1", "a.xlsx", 2, "look at the ice (90%)", "adult"), ("f1", "a.xlsx", 3, "sit down (10%)", "adult"), ("f2", "b.xlsx", 2, "look at the ice", "child")], "folder string, file string, line_no int, cell string, speaker string")
    got = {r["folder"]: (r["rows"], r["allowed"], r["calls"]) for r in jobs.deploy(spark, folder, cells, str(tmp_path / "out")).collect()}
    assert got == {"f1": (1, 75_000, 10), "f2": (1, 149_990, 10)} and (tmp_path / "out" / "_manifest.json").exists()
    assert jobs.deploy(spark, folder, cells, str(tmp_path / "out")).count() == 0 and spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_best_match_by_blocks(spark):
    rows = spark.createDataFrame([(k, [math.cos(k), math.sin(k)]) for k in range(50)], "id long, v array<double>")
    bank = spark.createDataFrame([(100 + k, [math.cos(k / 3), math.sin(k / 3)]) for k in range(19)] + [(7, [1.0, 0.0])], "id long, v array<double>")
    one = sorted(map(tuple, retrieval.best_match(rows, bank).collect()))
    assert one == sorted(map(tuple, retrieval.best_match(rows, bank, 3).collect())) and one[0][:2] == (0, 7)
    assert retrieval.best_match(rows, bank.limit(0)).count() == 0


def test_keyword_scan_finds_tokens_of_any_length(spark):
    from talkengine.operators import labelling

    index = spark.createDataFrame([("one two three four five", "TIER3", "x")], "token string, tier string, category string")
    df = spark.createDataFrame([("a", "We count: one two three four five!"), ("b", "one two three four")], "id string, text string")
    assert [(r["id"], r["labels"]) for r in labelling.keyword_labels(df, "id", "text", index).collect()] == [("a", ["content"])]


# ---------------------------------------------------------------- text of any script, terms of any sign


def test_text_of_any_script(spark):
    assert values(spark, T.canon("x"), ["ﬁne  STRASSE", "fine Straße", "ｆｉｎｅ strasse", None]) == ["fine strasse"] * 3 + [""]
    assert values(spark, T.word_count("x"), ["das Café ist näher", "a-b", None]) == [4, 2, None]
    assert values(spark, T.has_term("x", F.lit("T-shirt")), ["my t-shirt!", "my t shirt", "at-shirts", None]) == [True, False, False, None]
    assert values(spark, T.has_term("x", F.lit("caf")), ["a café", "a caf!"]) == [False, True] and values(spark, T.has_term("x", F.lit(r"a\E+")), [r"so a\E+ it"]) == [True]
    assert values(spark, T.well_formed("x", F.lit("ice-cream")), ["the ice-cream melts", "the ice cream melts"]) == [True, False]


def test_keyword_scan_of_signs_and_accents(spark):
    index = spark.createDataFrame([("t-shirt", "TIER3", "x"), ("café", "TIER3", "x"), ("what  if", "TIER3", "x")], "token string, tier string, category string")
    df = spark.createDataFrame([("a", "My T-shirt."), ("b", "my t shirt"), ("c", "CAFÉ!"), ("d", "caf"), ("e", "cafés"), ("f", "what if"), ("g", None)], "id string, text string")
    assert {r["id"] for r in labelling.keyword_labels(df, "id", "text", index).collect()} == {"a", "c"}


def test_sheet_names_are_unique(spark):
    df = spark.createDataFrame([("w", "a" * 40 + "1"), ("w", "a" * 40 + "2"), ("w", "b[x]"), ("v", "a" * 40)], "book string, child string")
    got = {(r["book"], r["child"]): r["sheet"] for r in T.unique_sheet_names(df, "child", ["book"]).collect()}
    assert len(set(v for (b, _), v in got.items() if b == "w")) == 3 and all(len(v) <= 31 for v in got.values()) and got[("w", "b[x]")] == "bx"


# ---------------------------------------------------------------- budget


def test_budget_is_exact_and_spread(spark):
    df = spark.createDataFrame([(f"r{k:03d}", 1.0 if k < 200 else 0.5 + k * 1e-7) for k in range(400)], "id string, s double")
    out = budget.running_cost(df, F.col("s"), F.lit(2), "id", ranges=7).collect()
    want = {i: 2 * k for k, (i, _) in enumerate(sorted(((r["id"], r["s"]) for r in out), key=lambda x: (-x[1], x[0])))}
    assert {r["id"]: r["calls_before"] for r in out} == want
    none = budget.spend(spark.createDataFrame([("a", None), ("b", 0.1)], "id string, s double"), F.col("s"), F.lit(1), "id", 1).collect()
    assert {r["id"]: r["taken"] for r in none} == {"a": False, "b": True}


def test_budget_carries_over(spark):
    assert budget.carried_over([("a", 1), ("b", 100), ("c", 100)], 10, 0.006, 0.0001) == [("a", 20, 10), ("b", 30, 30), ("c", 20, 20)]
    assert budget.carried_over([("a", 5), ("b", 9)], 10, 0.004, 0.0001, frozenset("a")) == [("b", 40, 40)]
    df = spark.createDataFrame([("a", "a1", 0.9, False), ("b", "b1", 0.9, True), ("b", "b2", 0.8, False), ("b", "b3", 0.7, False), ("c", "c1", 0.1, True)], "f string, id string, s double, hit boolean")
    got = {r["id"]: r["taken"] for r in budget.spend_rolling(df, "f", F.col("s"), F.col("hit"), "id", 10, 0.003, 0.0001).collect()}
    assert got == {"a1": True, "b1": True, "b2": True, "b3": False, "c1": True}
    assert {r["id"] for r in budget.spend_rolling(df, "f", F.col("s"), F.col("hit"), "id", 10, 0.003, 0.0001, frozenset("b")).collect()} == {"a1", "c1"}


# ---------------------------------------------------------------- requests, query path


def test_keys_and_kinds():
    env = {"K": "a, b", "K_2": "b,c", "K_3": "", "K_5": "z"}
    assert requests.api_keys("K", env) == ["a", "b", "c"] and requests.api_keys("X", env) == []
    for body, kind in (("fine, no error or quota here", "ok"), ("", "transient"), (None, "transient"), ('{"error": {"code": 401}}', "quota_auth"), ('{"error": "busy"}', "transient"), ('{"choices": [{"message": {"content": "x"}}]}', "ok"), ('{"choices": []}', "transient")):
        assert requests.kind_of(body) == kind


def test_key_ring_rotates_and_repeats():
    asked = []

    def call(key, system, user):
        asked.append(key)
        if user == "boom":
            raise OSError
        return '{"error": "quota"}' if key == "a" else "" if user == "slow" and asked.count(key) < 3 else "yes"

    ring = requests.KeyRing(["a", "b"], call)
    assert ring.ask("s", "u") == ("yes", "ok", 2) and ring.ask("s", "u") == ("yes", "ok", 1)  # stays with b
    assert ring.ask("s", "boom") == (None, "transient", 2)
    assert requests.KeyRing(["a"], call).ask("s", "u") == (None, "exhausted", 1)


def test_requests_ask_misses_once(spark, tmp_path):
    df = spark.createDataFrame([("k1", "s", "u1"), ("k1", "s", "u1"), ("k2", "s", "u2"), ("k3", "s", "bad")], "key string, system string, user string")
    cache = spark.createDataFrame([("k2", "old")], "key string, response string")
    path = str(tmp_path / "cache")
    rows = requests.answered(df, "key", cache, lambda k, s, u: "" if u == "bad" else f"{k}:{u}", ["a"], cache_path=path).collect()
    got = {r["key"]: (r["response"], r["kind"], r["cached"], r["calls"]) for r in rows}
    assert len(rows) == 4 and got == {"k1": ("a:u1", "ok", False, 1), "k2": ("old", "ok", True, 0), "k3": (None, "transient", False, 2)}
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [("k1", "a:u1")]
    led = requests.ledger(df, "key", cache).first()
    assert (led["hits"], led["misses"], led["total"]) == (2, 2, 4)


def test_pair_scores(spark):
    df = spark.createDataFrame([("a", "b"), ("c", "d"), ("e", None)], "q string, c string")
    call = lambda k, s, u: '{"score": 0.7, "rationale": "near"}' if "First: a" in u else "no idea" if "First: c" in u else ""
    got = {r["q"]: (r["llm_score"], r["error"]) for r in requests.pair_scores(df, "q", "c", call, [], "sys").collect()}
    assert got == {"a": (0.7, None), "c": (None, "no score"), "e": (None, "transient")}


def test_query_pipeline(spark):
    words = ("ice", "plant", "rock")

    def make():
        import numpy as np

        return lambda texts: np.array([[float(w in t) for w in words] for t in texts])

    bank = spark.createDataFrame([("u1", [1.0, 0.0, 0.0], "the ice", ["content"]), ("u2", [0.0, 1.0, 0.0], "a plant", None)], "id string, v array<double>, utterance string, subtype array<string>")
    asked = spark.createDataFrame([(1, "look at the ice"), (2, "sit down"), (3, "look at the ice")], "query_id int, phrase string")
    plain = pipeline.QueryPipeline(bank, make)
    got = {r["query_id"]: r for r in plain.classify(asked).collect()}
    assert got[1]["label"] == got[3]["label"] == "SCIENCE_TALK" and got[1]["best_id"] == "u1" and got[1]["degraded"] and got[2]["label"] == "NOT_SCIENCE_TALK" and got[2]["score"] == 0
    assert {(r["id"], r["subtype"]) for r in plain.retrieve(asked, 1).where("query_id = 1").collect()} == {("u1", "content")}
    scorer = lambda c: c.withColumns({"llm_score": F.when(F.col("id") == "u2", 0.9), "rationale": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    again = {r["query_id"]: (r["score"], r["best_id"], r["degraded"]) for r in pipeline.QueryPipeline(bank, make, scorer).classify(asked).collect()}
    assert again[1] == (0.9, "u2", False)
    assert pipeline.QueryPipeline(bank.limit(0), make).classify(asked).first()["n_candidates"] == 0
    with pytest.raises(ValueError):
        pipeline.QueryPipeline(bank.drop("v"), make)


@pytest.mark.parametrize("block,bank_block", [(7, 9), (1000, 11), (5, 1000)])
def test_top_k_by_blocks_of_both_sides(spark, block, bank_block):
    rows = [(k, [float(k % 5 == j) for j in range(5)]) for k in range(40)]  # many ties
    bank = spark.createDataFrame(rows, "id long, v array<double>")
    got = {}
    for r in retrieval.top_k(bank, bank, 3, block, bank_block).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    want = {q: [i for _, i in sorted((-float(q % 5 == i % 5), i) for i, _ in rows if i != q)[:3]] for q, _ in rows}
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == want


# ---------------------------------------------------------------- ingest, reviews, reports


def test_curated_workbook(spark, tmp_path):
    _curated(tmp_path / "c.xlsx")
    out = jobs.ingest(spark, str(tmp_path), str(tmp_path / "c.xlsx"))
    assert set(out) == {"corpus", "seed_words", "category_defs"}
    corpus = {r["utt_id"]: r for r in spark.read.parquet(f"{tmp_path}/corpus.parquet").collect()}
    assert corpus["utt_0000"]["utterance"] == "Look at the ice" and corpus["utt_0000"]["tier2_cues"] == ["look", "see"] and len(corpus) == 1
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/seed_words.parquet").select("term", "variants").collect()] == [("ice", ["ices", "icy"])]
    assert spark.read.parquet(f"{tmp_path}/category_defs.parquet").first()["definition"] == "what it is"
    with pytest.raises(ValueError):
        ingest.sheet(ingest.workbook(spark, str(tmp_path / "c.xlsx")), "Seed words", {"x": "Nowhere"})


def test_mined_rows_are_added_once(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([("utt_sci_0003", "We saw the ice melt in the sun today", "SCIENCE_TALK")], "utt_id string, utterance string, label string").transform(lambda d: schemas.conformed(d, "corpus")).write.parquet(f"{folder}/corpus.parquet")
    spark.createDataFrame([("ice", "TIER3", "PROPERTIES_MATERIALS", [], "g", None)], schemas.TABLES["seed_words"]).write.parquet(f"{folder}/seed_words.parquet")
    turns = spark.createDataFrame([("1LG", 2, "T1:", "WE SAW the ice  melt in the sun today", "SCI"), ("1LG", 3, "T1:", "Why does the ice float on the water here?", "SCI"), ("1LG", 4, "C1:", "Why does the ice float in the cup now?", "SCI"), ("1LG", 5, "T", "short one", "SCI")], "sheet string, row_no int, speaker string, utterance string, code string")
    assert jobs.merge_mined(spark, folder, turns, dry_run=True)["added"] == 0
    assert jobs.merge_mined(spark, folder, turns)["added"] == 1 and jobs.merge_mined(spark, folder, turns)["added"] == 0
    got = {r["utt_id"]: r for r in spark.read.parquet(f"{folder}/corpus.parquet").collect()}
    assert set(got) == {"utt_sci_0003", "utt_sci_0004"} and got["utt_sci_0004"]["setting"] == "Large Group" and got["utt_sci_0004"]["subtype"] == ["content"]


def test_reviews_of_negatives_and_corpus(spark, tmp_path):
    folder = str(tmp_path)
    schemas.conformed(spark.createDataFrame([("n1", "a", False), ("n2", "b", False), ("n3", "c", False)], "neg_id string, text string, human_verified boolean"), "negatives").write.parquet(f"{folder}/negatives.parquet")
    labels = spark.createDataFrame([("n1", "possible_leak"), ("n2", "unclear"), ("n9", "UNCLEAR"), ("n3", " ")], "neg_id string, human_label string")
    assert jobs.review_negatives(spark, folder, labels) == {"before": 3, "after": 2, "missing": 1}
    assert {r["neg_id"]: (r["human_verified"], r["human_label"]) for r in spark.read.parquet(f"{folder}/negatives.parquet").collect()} == {"n2": (True, "UNCLEAR"), "n3": (False, None)}
    with pytest.raises(ValueError):
        jobs.review_negatives(spark, folder, spark.createDataFrame([("n2", "what")], "neg_id string, human_label string"))
    schemas.conformed(spark.createDataFrame([("u1", "x"), ("u2", "y"), ("u3", "z")], "utt_id string, utterance string"), "corpus").write.parquet(f"{folder}/corpus.parquet")
    schemas.conformed(spark.createDataFrame([("p1", "u1"), ("p2", "u2"), ("p3", "u3")], "pair_id string, anchor_id string"), "pairs").write.parquet(f"{folder}/pairs.parquet")
    decisions = spark.createDataFrame([("u1", "Drop", None), ("u2", "edit", "new"), ("u3", None, None)], "utt_id string, decision string, corrected_text string")
    assert jobs.review_corpus(spark, folder, decisions) == {"corpus_before": 3, "corpus_after": 2, "pairs_before": 3, "pairs_after": 1}
    assert {r["utt_id"]: r["utterance"] for r in spark.read.parquet(f"{folder}/corpus.parquet").collect()} == {"u2": "new", "u3": "z"}
    with pytest.raises(ValueError):
        jobs.review_corpus(spark, folder, spark.createDataFrame([("u2", "edit", " ")], "utt_id string, decision string, corrected_text string"))


def test_audit_round_trip(spark):
    audit = spark.createDataFrame([("a", "pair", "auto", " Auto "), ("b", "pair", "spot", "review"), ("c", "negative", None, "auto"), ("d", "pair", "auto", None)], "id string, kind string, routing string, human_routing string").withColumn("confidence", F.lit(0.1))
    now = review.refreshed(audit, spark.createDataFrame([("a", "auto", 0.9), ("b", "review", 0.1), ("c", "spot", 0.2)], "id string, routing string, confidence double"))
    got = {(r["kind"], r["routing"]): (r["n"], round(r["agreement"], 3), r["met"]) for r in review.audit_result(now).collect()}
    assert got[(None, None)] == (3, 0.667, False) and got[("pair", None)] == (2, 1.0, True) and got[(None, "spot")] == (1, 0.0, False)
    assert {tuple(r) for r in review.disagreements(now).collect()} == {("auto", "auto", 1), ("review", "review", 1), ("spot", "auto", 1)}
    assert review.ordered_columns(audit, ["id"], ["routing", "none"], ["human_routing"], ["confidence"]).columns == ["id", "routing", "human_routing", "confidence", "kind"]
    assert review.template(audit, ["kind"], "id", ["note"], 2).count() == 2


def test_folders_and_reports(spark, tmp_path):
    assert ingest.folders(["b", "a", "x1", "x1_updated"], every=True, doubled="x1") == ["a", "b", "x1_updated"] and ingest.folders([], ["q"]) == ["q"]
    with pytest.raises(ValueError):
        ingest.folders(["a"])
    assert [reports.number(v) for v in (None, 1234, 0.5, True, "x")] == ["n/a", "1,234", "0.500", "yes", "x"]
    text = reports.markdown(spark.createDataFrame([("a|b", 1.0)], "n string, v double"), "T")
    assert "a\\|b | 1.000" in text and reports.gates({"x": 0.9}, {"x": 0.8, "y": 0.1}) == [("x", 0.9, 0.8, True), ("y", None, 0.1, False)]
    reports.write_text(spark, f"{tmp_path}/r.md", text)
    assert (tmp_path / "r.md").read_text() == text


def test_category_definitions(spark):
    rows = [("b", "Category", "two"), ("a", "category label", None), ("z", "note", "x")]
    df = spark.createDataFrame(rows, "label string, type string, definition string")
    assert prompts.definitions(df).first()[0] == "- a: \n- b: two" and prompts.definitions(df.where("label = 'z'")).first()[0] == "- z: x"


def test_stability(spark):
    df = spark.createDataFrame([(k / 10, k / 9, -k / 3) for k in range(8)], "a double, b double, c double")
    assert evaluation.stability(df, "a", "b").first()["stable"] and not evaluation.stability(df, "a", "c").first()["stable"]


def test_triples_deal_all_hard_negatives(spark):
    pairs_ = spark.createDataFrame([(f"p{k}", "u1", f"q{k}") for k in range(5)] + [("x", "u2", "q"), ("y", "u9", "q")], "pair_id string, anchor_id string, query string")
    corpus = spark.createDataFrame([("u1", "one"), ("u2", "two")], "anchor_id string, positive string")
    hard = spark.createDataFrame([("n1", "u1", "h1"), ("n2", "u1", "h2"), ("n3", "u1", "h3")], "neg_id string, anchor_id string, text string")
    rows = evaluation.training_triples(pairs_, corpus, hard)
    got = {r["pair_id"]: r["hard_negative"] for r in rows.collect()}
    assert len(got) == 6 and got["x"] is None and sorted(v for k, v in got.items() if k != "x").count("h1") in (1, 2) and {v for v in got.values() if v} == {"h1", "h2", "h3"}
    texts = {r["pair_id"]: r["texts"] for r in evaluation.training_examples(rows).collect()}
    assert texts["x"] == ["search_query: q", "search_document: two"] and len(texts["p0"]) == 3


def test_subtype_model_and_health(spark):
    call = lambda k, s, u: '{"choices": [{"message": {"content": "{\\"subtypes\\": [\\"content\\"], \\"confidence\\": 0.8}"}}]}' if "ice" in u else ""
    df = spark.createDataFrame([("a", "the ice"), ("b", "sit")], "id string, text string")
    assert {r["id"]: (r["subtype"], r["subtype_confidence"]) for r in requests.subtype_model(call, [])(df).collect()} == {"a": (["content"], 0.8), "b": (["not_science_shape"], 0.0)}
    assert requests.reachable(lambda k, s, u: "ok", ["a"]) == "ok" and requests.reachable(lambda k, s, u: '{"error": "expired"}', ["a"]) == "exhausted"
    assert requests.text_of("plain") == "plain" and requests.text_of(None) == ""
    with pytest.raises(ValueError):
        requests.completion("", "m")


def test_without_tokens_by_chunks(spark):
    rows = spark.createDataFrame([("the Icebox",), ("nothing",), (None,), ("a plant",)], "t string")
    tokens = spark.createDataFrame([("ice",), ("plant",), ("",), (None,)], "w string")
    for chunk in (1, 100):
        assert sorted((r["t"] or "") for r in mining.without_tokens(rows, "t", tokens, "w", chunk).collect()) == ["", "nothing"]
