"""Copies, families, near-duplicates and overlaps against brute force on small fixtures."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from talkengine.llm import copies, families, nearest, overlaps
from talkengine.llm.words import folded, words

NOUNS = "shell marble seed bridge lantern puddle acorn feather magnet river beam cork dough ember fossil gravel".split()
VERBS = "lift melt roll carry notice measure draw blow".split()


def sentence(r):
    return f"We {r.choice(VERBS)} the {r.choice(NOUNS)} and the {r.choice(NOUNS)} near a {r.choice(NOUNS)} before lunch, then {r.choice(VERBS)} it again."


def edited(text, r):
    w = text.split()
    w[r.randrange(len(w))] = r.choice(NOUNS)
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    base = [sentence(r) + " " + sentence(r) for _ in range(60)]
    rows = [(f"r{k:03d}", t) for k, t in enumerate(base)]
    rows += [(f"c{k:03d}", edited(t, r)) for k, t in enumerate(base[:30])]
    rows += [(f"d{k:03d}", t.upper().replace(" ", "  ")) for k, t in enumerate(base[:10])]
    return rows + [("e1", None), ("e2", ""), (None, "no id"), ("e3", "short text"), ("long", " ".join(f"w{k}" for k in range(20000))), rows[0]]


def similar(a, b):
    x, y = set(words(a)), set(words(b))
    return len(x) >= 8 and len(y) >= 8 and len(x & y) >= 0.8 * len(x | y)


def clashing(df):
    return df.withColumn("h", F.lit("x")).withColumn("canon", F.lit(1)).withColumn("key", F.lit(2)).withColumn("words", F.lit(3))


def test_words_concatenate_to_folded():
    for t in ("Don't STOP, now!", "ｆｕｌｌ Width № 5", "a_b c", "", "é’è ß"):
        assert "".join(words(t)) == folded(t)
    assert words("Don’t can't") == ["dont", "cant"]


def test_copies(spark):
    rows = [
        ("b", "Look, a Shell!"), ("a", "look a shell"), ("c", "LOOK — a shell"), ("d", "Look a bell"), ("a", "look a shell"),
        ("f2", "speaker: T1 | day: Fri"), ("f1", "Day:FRI ; Speaker: t1"), ("f3", "speaker: T1 | day: Mon"), ("p", "speaker T1 day Fri"),
        ("n", None), (None, "x"), ("e1", ""), ("e2", " .. "),
    ]
    df = clashing(spark.createDataFrame(rows, "id string, text string"))
    got = {tuple(r) for r in copies.find_copies(copies.canonical_records(df, "id", "text", "t")).collect()}
    assert got == {("a", "b"), ("a", "c"), ("f1", "f2"), ("e1", "e2")}


@pytest.mark.parametrize("capacity", [1, 3, 1000])
def test_radix_splits_do_not_change_counts(spark, capacity):
    r = random.Random(1)
    rows = [(str(k), "same beginning of a long text " + r.choice("abc") * r.randrange(1, 90)) for k in range(300)] + [("hot%d" % k, "hot") for k in range(200)]
    rec = copies.written(copies.canonical_records(spark.createDataFrame(rows, "id string, text string"), "id", "text", "t"), "t")
    got = {bytes(x["canon"]): (x["n_copies"], x["kept_id"]) for x in copies.counted(rec, capacity).collect()}
    want = {}
    for i, t in rows:
        n, least = want.get(copies.canonical(t), (0, i))
        want[copies.canonical(t)] = (n + 1, min(least, i))
    assert got == want


def test_copies_of_nothing(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert copies.find_copies(copies.canonical_records(df, "id", "text")).count() == 0


def components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    out = {}
    for x in list(root):
        out.setdefault(find(x), set()).add(x)
    return {frozenset(v) for v in out.values()}


def test_spanning_forest(spark):
    r = random.Random(5)
    edges = [(f"n{r.randrange(80):02d}", f"n{r.randrange(80):02d}") for _ in range(70)] + [(f"leaf{k}", "hub") for k in range(50)] + [(f"path{k:02d}", f"path{k + 1:02d}") for k in range(40)]
    edges = [e for e in edges if e[0] != e[1]]
    df = spark.createDataFrame([*edges, edges[0], (None, "x"), ("y", None), ("z", "z")], "a string, b string")
    forest, labels = families.spanning_forest(df)
    by = {}
    for x in labels.collect():
        by.setdefault(x["root"], set()).add(x["node"])
    want = components(edges)
    assert {frozenset(v) for v in by.values()} == want
    picked = {tuple(sorted((x["a"], x["b"]))) for x in forest.collect()}
    assert len(picked) == sum(len(c) - 1 for c in want) and components(picked) == want


def test_empty_forest(spark):
    forest, labels = families.spanning_forest(spark.createDataFrame([], "a string, b string"))
    assert forest.count() == labels.count() == 0


@pytest.mark.parametrize("top", [0, 50])
def test_deal_keeps_proportions(spark, top):
    r = random.Random(2)
    sizes = [("big", 3000)] + [(f"f{k}", r.choice([1, 1, 1, 2, 3, 5, 9, 40])) for k in range(4000)]
    dealt = families.deal(spark.createDataFrame(sizes, "root string, size long"), top=top).collect()
    assert len(dealt) == len(sizes) and len({x["root"] for x in dealt}) == len(sizes)
    total = sum(n for _, n in sizes)
    share = {s: sum(x["size"] for x in dealt if x["split"] == s) / total for s in ("train", "val", "test")}
    near = 0.03 if top else 0.12
    assert abs(share["train"] - 0.8) < near and abs(share["val"] - 0.1) < near and abs(share["test"] - 0.1) < near


def test_near_duplicates(spark, texts):
    df = clashing(spark.createDataFrame(texts, "id string, text string"))
    got = [tuple(x) for x in nearest.pairs(nearest.near_duplicates(df)).collect()]
    known = dict(x for x in texts if x[0] and x[1])
    want = {(a, b) for a, b in itertools.combinations(sorted(known), 2) if similar(known[a], known[b])}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30


def test_near_duplicate_groups(spark, texts):
    found = nearest.near_duplicates(spark.createDataFrame(texts, "id string, text string"))
    rows = nearest.groups(found).collect()
    known = dict(x for x in texts if x[0] and x[1])
    want = components((a, b) for a, b in itertools.combinations(sorted(known), 2) if similar(known[a], known[b]))
    by = {}
    for x in rows:
        by.setdefault(x["group_id"], set()).add(x["id"])
    assert {frozenset(v) for v in by.values()} == want and len(rows) == len({x["id"] for x in rows})


def test_near_duplicates_of_nothing(spark):
    found = nearest.near_duplicates(spark.createDataFrame([], "id string, text string"))
    assert nearest.pairs(found).count() == 0 and nearest.groups(found).count() == 0


def test_many_copies_meet_once(spark):
    rows = [(f"h{k}", "We lift the shell and the marble near a seed before lunch") for k in range(400)]
    found = nearest.near_duplicates(spark.createDataFrame(rows, "id string, text string"))
    assert found.links.count() == 0 and nearest.pairs(found).count() == 400 * 399 // 2


def test_overlaps(spark, texts):
    r = random.Random(9)
    rows = [(i, "s", r.choice(["train", "train", "val", "test", None]), t) for i, t in texts]
    df = clashing(spark.createDataFrame([*rows, rows[0]], "id string, source string, split string, text string"))
    got = {tuple(sorted((x["train_id"], x["eval_id"]))) for x in overlaps.overlaps(df).collect()}
    known = {i: (s, t) for i, _, s, t in rows if i and t and s}
    want = {(a, b) for a, b in itertools.combinations(sorted(known), 2) if (known[a][0] == "train") != (known[b][0] == "train") and similar(known[a][1], known[b][1])}
    assert got == want and len(want) > 10


def test_overlaps_by_shards_and_blocks(spark, texts):
    r = random.Random(9)
    rows = [(i, "s", r.choice(["train", "val"]), t) for i, t in texts]
    df = spark.createDataFrame(rows, "id string, source string, split string, text string")
    one = {tuple(x) for x in overlaps.overlaps(df).select("train_id", "eval_id", "matched_words").collect()}
    small = overlaps.Search(shard_words=300, hits=50)
    assert {tuple(x) for x in overlaps.overlaps(df, small).select("train_id", "eval_id", "matched_words").collect()} == one and one


@pytest.mark.parametrize("only", ["train", "val", None])
def test_overlaps_with_one_side(spark, only):
    rows = [(str(k), "s", only, "We lift the shell and the marble near a seed") for k in range(3)]
    assert overlaps.overlaps(spark.createDataFrame(rows, "id string, source string, split string, text string")).count() == 0


def test_index_finds_every_maximal_match():
    import numpy as np

    r = random.Random(4)
    docs = sorted({" ".join(r.choice(NOUNS[:14]) for _ in range(r.randrange(8, 30))) for _ in range(40)})
    n = np.array([len(set(d.split())) for d in docs])
    how = overlaps.Search(threshold=0.3)
    index = overlaps.Index.unpacked(overlaps.Index.build(docs, {"h": n, "g": n, "fold": n, "n": n, "sketch": n}, how).packed())
    names = dict(zip(index.ids.values(), index.ids))
    laid = [sorted(index.ids[w] for w in set(d.split()))[:z] for d, z in zip(docs, how.zone(n))]
    query = sorted(r.sample(sorted(names), 10))
    for hits in (3, 10_000):
        got = sorted(t for _, text in index.matches(np.zeros(10, np.int64), np.array(query), hits) for t in text.tolist())
        want = []
        for k, own in enumerate(laid):
            runs = [i for i in range(9) for j in range(len(own) - 1) if own[j : j + 2] == query[i : i + 2]]
            want += [k for i in runs if i - 1 not in runs]
        assert got == sorted(want) and len(want) > 10


@pytest.mark.parametrize("n", [8, 9, 13, 20, 37, 64])
def test_zone_holds_two_neighbours_of_every_similar_text(n):
    import numpy as np

    r = random.Random(n)
    zone = lambda k: int(overlaps.Search().zone(np.array([k]))[0])
    for _ in range(3000):
        a = r.randrange(0, n // 5 + 1)
        b = r.randrange(0, int((n - a) / 4 + 1e-9) - a + 1) if (n - a) // 4 >= a else 0
        if (n - a) / (n + b) < 0.8:
            continue
        order = r.sample(range(10 * n), n + b)
        x, y = sorted(order[:n]), sorted(order[a:])
        runs = lambda s: set(zip(s, s[1:]))
        assert runs(x[: zone(n)]) & runs(y[: zone(len(y))])


def test_splits_read_in_any_spelling(spark):
    df = spark.createDataFrame([(" Train ",), ("VALIDATION",), ("test",), ("other",), (None,)], "s string")
    assert [x[0] for x in df.select(overlaps.split_name(F.col("s"))).collect()] == ["train", "val", "test", None, None]


def test_equal_folded_texts_overlap_whatever_their_words(spark):
    rows = [("a", "s", "train", "today we all put the ice cream next to that warm lamp"), ("b", "s", "val", "today we all put the icecream next to that warm lamp")]
    df = spark.createDataFrame(rows, "id string, source string, split string, text string")
    assert [(x["train_id"], x["eval_id"]) for x in overlaps.overlaps(df).collect()] == [("a", "b")]


def test_overlaps_without_a_shared_run(spark):
    r = random.Random(7)
    common = [sentence(r) for _ in range(30)]
    rows = []
    for k in range(40):
        own = [f"own{k}x{j}" for j in range(r.choice([6, 20, 40, 60, 90]))] + r.sample("the a we to and it near then".split(), 4)
        other = own[: -1 if k % 2 else None] + (["odd"] if k % 3 else [])
        rows += [(f"t{k:02d}", "s", "train", " ".join(own)), (f"v{k:02d}", "s", "val", " ".join(r.sample(other, len(other))))]
    rows += [(f"c{k:02d}", "s", r.choice(["train", "val"]), t) for k, t in enumerate(common)]
    df = spark.createDataFrame(rows, "id string, source string, split string, text string")
    known = {i: (s, t) for i, _, s, t in rows}
    want = {(a, b) for a, b in itertools.product(sorted(known), repeat=2) if known[a][0] == "train" and known[b][0] == "val" and similar(known[a][1], known[b][1])}
    for small in ({}, {"shard_words": 300, "hits": 20}):
        assert {(x["train_id"], x["eval_id"]) for x in overlaps.overlaps(df, overlaps.Search(**small)).collect()} == want
    assert len(want) >= 40


def test_overlaps_of_a_template_letter_spaced_joined_and_reordered_texts(spark):
    base = "we lift the shell and the marble near a seed before lunch while friends wait outside".split()
    rows = [("t0", "s", "train", " ".join(base)), ("t1", "s", "train", "today we all put the ice cream next to that warm lamp and the rain coat")]
    rows += [(f"v{k:02d}", f"s{k % 2}", "val", " ".join([*base, f"odd{k}"])) for k in range(40)]
    rows += [("r0", "s", "test", " ".join(reversed(base))), ("l0", "s", "test", " ".join(" ".join(w) for w in base)), ("j0", "s", "val", "today we all put the icecream nextto that warmlamp and the raincoat")]
    df = spark.createDataFrame(rows, "id string, source string, split string, text string")
    want = {("t0", i) for i, *_ in rows[2:-1] if i != "l0"} | {("t1", "j0")}  # letter-spaced, a text has few different words
    for how in (overlaps.Search(), overlaps.Search(shard_words=40, hits=5)):
        assert {(x["train_id"], x["eval_id"]) for x in overlaps.overlaps(df, how).collect()} == want | {("t0", "l0")}
    copies = df.union(df.where("id = 't0'").withColumn("id", F.lit("t9"))).union(df.where("id = 'v01'").withColumn("id", F.lit("v99")))
    found = {(x["split"], x["source"]): (x["n_records"], x["n_overlaps"]) for x in overlaps.report(overlaps.search(copies)).collect()}
    assert found == {("val", "s0"): (20, 40), ("val", "s1"): (21, 42), ("test", "s"): (2, 4), ("val", "s"): (1, 1)}


def test_a_missing_shard_is_no_empty_one(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        overlaps._read_shard(f"file://{tmp_path}", 3)


def test_matched_words():
    assert overlaps._matched([1, 2, 3, 4, 5, 9, 9, 1, 2, 3, 4], [1, 2, 3, 4, 5], 4) == (9, 2) and overlaps._matched([1, 2], [1, 2], 4) == (0, 0)
    assert overlaps._matched([5, 1, 2, 3, 4, 6, 7, 8, 9], [6, 7, 8, 9, 0, 1, 2, 3, 4], 4) == (8, 1)


def test_every_record_is_assigned(spark, tmp_path):
    from talkengine.llm import queries

    def table(name, rows, kinds):
        spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{name}.parquet")

    table("corpus", [("u1",), ("u1",), ("u2",)], "utt_id string")
    table("pairs", [("p1", " U1 "), ("p2", None)], "pair_id string, anchor_id string")
    table("negatives", [("n1",), ("n1",), ("n2",), (None,)], "neg_id string")
    table("splits", [("n1", "train"), ("s1", None), ("p1", "val")], "id string, split string")
    rows = [tuple(r) for r in queries.p3_assignment(spark, str(tmp_path)).collect()]
    assert sorted(r[0] for r in rows) == ["n1", "n2", "p1", "p2", "s1", "u1", "u2"] and all(s in ("train", "val", "test") for _, _, s in rows)
    family = {i: f for i, f, _ in rows}
    assert family["u1"] == family["p1"] and len(set(family.values())) == 6


def test_a_crowded_prefix_gets_longer_ones(spark):
    """A third of all texts holds the same 30 words and few of its own, so whole tries lie under one prefix."""
    r = random.Random(5)
    common = [f"same{k}" for k in range(30)]
    texts = [" ".join(common + [f"own{k}x{j}" for j in range(r.choice([2, 8, 9]))]) for k in range(60)]
    texts += [" ".join(f"far{k}x{j}" for j in range(12)) for k in range(20)] + [sentence(r) for _ in range(60)]
    rows = [(f"i{k:03d}", t) for k, t in enumerate(texts)]
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if similar(x, y)}
    df = spark.createDataFrame(rows, "id string, text string")
    for forest in (nearest.Forest(), nearest.Forest(crowd=12, levels=1), nearest.Forest(crowd=8, levels=2)):
        found = nearest.near_duplicates(df, forest=forest)
        assert {tuple(x) for x in nearest.pairs(found).collect()} == want and len(want) > 200
        assert found.recall().first()["recall"] >= forest.target_recall


def test_trees_reach_the_target_at_the_threshold():
    for depth in (2, 4, 6):
        f = nearest.Forest(depth=depth)
        assert 1 - (1 - 0.8**depth) ** f.trees >= f.target_recall > 1 - (1 - 0.8**depth) ** (f.trees - 1)


def test_meetings_are_all_pairs_of_a_node():
    import numpy as np

    f = nearest.Forest(threshold=0.01)
    sizes = [1, 2, 47, 48, 49, 130, 300]
    first = np.concatenate([np.arange(n) == 0 for n in sizes])
    h = np.arange(sum(sizes))
    got = [(int(a), int(b)) for x, y in nearest._meetings(h, np.full(len(h), 255, np.uint64), first, f) for a, b in zip(x, y)]
    at = np.cumsum([0, *sizes])
    want = {(a, b) for k in range(len(sizes)) for a, b in itertools.combinations(range(at[k], at[k + 1]), 2)}
    assert len(got) == len(want) and {tuple(sorted(x)) for x in got} == want


def test_a_kept_forest_stands_for_its_edges(spark):
    r = random.Random(8)
    edges = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(90)]
    forest, labels = families.spanning_forest(spark.createDataFrame(edges, "a string, b string"))
    kept = [tuple(x) for x in forest.select("a", "b").collect()]
    of = lambda es: {frozenset(c) for c in components(es)}
    assert of(kept) == of([e for e in edges if e[0] != e[1]]) and len(kept) == labels.count() - labels.select("root").distinct().count()
    more = [("n0", "x"), ("x", "n1")]
    again = families.spanning_forest(spark.createDataFrame(kept + more, "a string, b string"))[1]
    by = {}
    for x in again.collect():
        by.setdefault(x["root"], set()).add(x["node"])
    assert {frozenset(v) for v in by.values()} == of([e for e in edges if e[0] != e[1]] + more)
