"""Defects, personal information, packing, mixing and spam on small fixtures."""

import pytest
from pyspark.sql import functions as F

from talkengine.llm import defects, mixing, packing, pii, spam, tokens

ANCHORS = [
    "We saw a {a} by the gate today. Why do you think the {b} got so wet? Put the cup next to the {a} and stir it.",
    "How could we lift the {a} without the rope? It started to melt because the {b} was too warm. Look how the {a} can float!",
    "I predict the {a} will sink when we drop it. Does the {b} look round through the glass? My evidence is the mark on the {a}.",
]
THINGS = "shell marble seed bridge lantern puddle acorn feather magnet river cork fossil".split()


def pairs():
    rows = []
    for k in range(240):
        a, b = THINGS[k % 12], THINGS[(k * 5 + 1) % 12]
        rows.append((f"p{k:03d}", ANCHORS[k % 3].format(a=a, b=b), ANCHORS[(k + 1) % 3].format(a=THINGS[(k + 3) % 12], b=THINGS[(k + 7) % 12])))
    anchor = rows[0][1]
    rows += [
        ("empty1", anchor, None), ("empty2", anchor, " \n"), ("empty3", anchor, "[no response]"), ("empty4", anchor, "N/A"),
        ("copy1", anchor, anchor), ("copy2", anchor, "Answer: " + anchor.upper()), ("copy3", anchor, anchor + " " + anchor),
        ("refusal1", anchor, "I'm sorry, but I can't help with that request."), ("refusal2", anchor, "Request declined."),
        ("foreign1", anchor, "Hoy mezclamos la concha con el agua y creo que la semilla está muy mojada."), ("foreign2", anchor, "Ich denke, wir sehen die Muschel nicht, weil es im Garten dunkel ist."),
        ("cut1", anchor, "How could we lift the seed without the rope? It started to melt bec"), ("cut2", anchor, "Does the shell look round through the glass? My evidence is the"),
        ("fine1", anchor, "Sorry, I cannot reach that shelf! How could we lift the cork without the rope?"), ("fine2", anchor, "Why not?"),
        ("fine3", None, "How could we lift the seed without the rope? Look how the cork can float"), (None, anchor, "x"),
    ]
    return rows + [rows[0]]


def test_defects(spark):
    df = spark.createDataFrame(pairs(), "id string, prompt string, reply string").withColumn("defect", F.lit(1)).withColumn("text", F.lit(2))
    got = {r["id"]: r["defect"] for r in defects.judged(df, "id", "prompt", "reply").collect()}
    names = {"empty": "empty", "copy": "anchor_copy", "refusal": "refusal", "foreign": "other_language", "cut": "truncated", "fine": None, "p": None}
    wrong = {i: d for i, d in got.items() if d != names[i.rstrip("0123456789")]}
    assert not wrong and len(got) == 256


def test_coverage_of_a_small_edit():
    assert defects.defect([9, 13, 7], [1, 0, 0], [0, 2, 2]) == "anchor_copy" and defects.defect([9, 13, 7], [6, 9, 4], [0, 2, 0]) is None
    assert defects.defect([4, 13, 7], [4, 0, 0], [0, 2, 2]) == "anchor_copy" and defects.defect([9, 3], [9, 3], [0, 4]) == "truncated"


def test_defects_of_nothing(spark):
    assert defects.judged(spark.createDataFrame([], "id string, prompt string, reply string"), "id", "prompt", "reply").count() == 0


def test_field_learns_an_easy_task():
    data = [([["a"], ["b"]], [0, 1])] * 20 + [([["b"]], [1])] * 20
    field = defects.train(data, 60)
    assert field.moves.shape == (5, 5) and field.names.keys() == {"a", "b"} and field.weights[field.names["a"]].argmax() == 0


TALK = [
    "Tell Orvan Quillwick we said hi. We saw a shell by the gate.", "Nobody pushed Orvan. Look at the seed.", "I saw Orvan Quillwick share the blocks with Velda Mossley.",
    "Ask Velda about the chart.", "Today we told Velda Mossley to wait.", "We miss Orvan since the move.", "The form came from Quillwick and Mossley.",
]


def found(spark, texts):
    rows = [(f"t{k}", t) for k, t in enumerate(TALK)] + texts
    df = spark.createDataFrame(rows, "id string, text string").withColumn("pii_types", F.lit(0))
    return {r["id"]: (r["redacted"], r["pii_types"]) for r in pii.redacted(df, "id", "text").collect()}


def test_placeholders(spark):
    got = found(spark, [
        ("mail", "Write to a.b@oak.school.example or c_9 (at) d.test now."), ("mail2", "It is velda underscore 3 at oak dot prek dot test."),
        ("phone", "Call +44 1632 960489, (208) 555-0144 or 12085550184."), ("kit", "Kit no. 705-2990 and barcode 574509970156 on page 12, edition 2016-11."),
        ("id", "passport LQ1661399, SSN 000 97 5106, student ID S-871-4437, medical card no. 4414 0209 41"), ("addr", "She lives in 12 Takarmere Way, Apt 7 or P.O. Box 398, Marshgate."),
        ("low", "tell velda we said hi"), ("decoy", "Captain Pebble, the Violet table, Biscuit the hamster and Green Group read Pebble Street on Friday."),
        ("none", None), ("blank", ""), (None, "Orvan"), ("mail", "Write to a.b@oak.school.example or c_9 (at) d.test now."),
    ])
    assert got["t0"] == ("Tell [NAME] we said hi. We saw a shell by the gate.", ["name"])
    assert got["mail"][1] == got["mail2"][1] == ["email"] and got["mail"][0].count("[EMAIL]") == 2
    assert got["phone"] == ("Call [PHONE], [PHONE] or [PHONE].", ["phone"])
    assert got["kit"][1] == got["decoy"][1] == got["none"][1] == got["blank"][1] == [] and got["none"][0] is None
    assert got["id"][1] == ["id_number"] and got["id"][0].count("[ID_NUMBER]") == 4
    assert got["addr"][1] == ["address"] and got["addr"][0].count("[ADDRESS]") == 2
    assert got["low"][1] == ["name"] and None not in got


def test_surrogates_are_consistent_and_distinct(spark):
    rows = [(f"t{k}", t) for k, t in enumerate(TALK)] + [("n", "Call 208-555-0144 now, ORVAN!"), ("z", None)]
    df = spark.createDataFrame(rows, "id string, text string")
    a = {r[0]: r[1] for r in pii.surrogates(df, "id", "text", b"k").collect()}
    assert a == {r[0]: r[1] for r in pii.surrogates(df, "id", "text", b"k").collect()}
    given = a["t1"].split()[2].rstrip(".")
    assert given != "Orvan" and a["t0"].startswith(f"Tell {given} ") and given.upper() in a["n"] and a["z"] is None
    assert "208-555-0144" not in a["n"] and len(a["n"].split()[1]) == 12


def test_colliding_surrogates_are_drawn_again(spark, monkeypatch):
    monkeypatch.setattr(pii, "surrogate", lambda unit, word, key, turn: "same" if turn == 0 else "b" if turn == 1 else f"{word}{turn}")
    df = spark.createDataFrame([("word", w) for w in "abc"], "unit string, value string")
    made = {r["value"]: r["made"] for r in pii.unit_surrogates(df, b"k").collect()}
    assert set(made) == set("abc") and len(set(made.values())) == 3 and not set(made.values()) & set("abc")


def test_surrogates_never_run_out(spark, monkeypatch):
    monkeypatch.setattr(pii, "surrogate", lambda unit, word, key, turn: "same")
    df = spark.createDataFrame([(u, w) for u in ("word", "house") for w in "123"], "unit string, value string")
    made = {(r["unit"], r["value"]): r["made"] for r in pii.unit_surrogates(df, b"k", rounds=2).collect()}
    assert len(made) == 6 and all(len({m for (x, _), m in made.items() if x == u}) == 3 for u in ("word", "house")) and "1" not in made.values()


def test_surrogates_keep_what_is_one_and_part_what_is_not(spark):
    rows = [(f"t{k}", t) for k, t in enumerate(TALK)]
    rows += [("m1", "Write to velda.m1987@oak.test now."), ("m2", "Write to velda.m1987@elm.test now."), ("m3", "Write to 7421@oak.test now."), ("m4", "Write to velda.m1987 (at) oak dot test now."), ("m5", "Write to j@oak.test now.")]
    rows += [("bo", "We told Bo Quillwick and J. Mossley to wait."), ("p1", "Call +1 208-555-0144 now."), ("p2", "Call 208-555-0144 now."), ("p3", "Call (208) 555.0145 ext. 12 now.")]
    rows += [("a1", "She lives in 12 Takarmere Lane now."), ("a2", "She lives in 12 Takarmere Lane, Apt 7 now.")]
    rows += [(f"h{k}", f"She lives in {k} Kettlemoor Lane now.") for k in range(1, 100)]
    got = {r["id"]: (r["surrogate_text"], r["pii_types"], r["redacted"]) for r in pii.protected(spark.createDataFrame(rows, "id string, text string"), "id", "text", b"k").collect()}
    mails = [got[f"m{k}"][0].split()[2] for k in (1, 2, 3, 5)]
    assert len(set(mails)) == 4 and all(m.endswith("@example.org") and not any(x in m for x in ("velda", "1987", "7421", "oak", "elm")) for m in mails)
    assert got["m4"][0].split()[2] == mails[0].split("@")[0] and got["m1"][1] == ["email"] and got["m1"][2] == "Write to [EMAIL] now."
    assert "Quillwick" not in got["bo"][0] and "Mossley" not in got["bo"][0] and "J. " not in got["bo"][0] and got["t3"][0] != dict(rows)["t3"]
    phone = {k: got[k][0][5:-5] for k in ("p1", "p2", "p3")}
    assert phone["p1"] == f"+1 {phone['p2']}" != "+1 208-555-0144" and phone["p3"][1:4] == phone["p2"][:3] != "208" and phone["p3"][6:14].replace(".", "-") != phone["p2"][4:] and phone["p3"][15:19] == "ext."
    assert got["a2"][0].startswith(got["a1"][0][:-5] + ", Apt ") and "Takarmere" not in got["a1"][0]
    houses = [got[f"h{k}"][0].split()[3] for k in range(1, 100)]
    assert len(set(houses)) == 99 and not {int(h) for h in houses if h[0] != "0"} & set(range(1, 100)) and len({got[f"h{k}"][0].split()[4] for k in range(1, 100)}) == 1


def test_cut_only_over_capacity():
    assert list(packing.cut(10, 10)) == [(0, 0, 10)] and list(packing.cut(25, 10)) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)] and list(packing.cut(0, 10)) == [(0, 0, 0)]


def test_packing(spark):
    import random

    r = random.Random(6)
    sizes = [(k, r.choice([5, 9, 30, 60, 99, 250, 400])) for k in range(900)] + [(1000, 0), (1001, 1234), (1002, None), (None, 5), (0, 5)]
    df = spark.createDataFrame(sizes, "id long, n_tokens long").withColumn("shard", F.lit("x"))
    caps = {"small": 64, "large": 256}
    for packed, kinds in ((packing.pack(df, caps), {"small", "large"}), (packing.pack(df, caps, shard_tokens=9000), {"small", "large"}), (packing.pack_tiers(df, caps), {""})):
        rows = packed.collect()
        fills = packing.fills(packed).collect()
        assert all(f["used_tokens"] <= f["capacity_tokens"] and f["capacity_tokens"] == caps[f["container_name"]] for f in fills)
        known = dict(x for x in sizes if x[0] is not None and x[1] is not None)
        known[0] = max(n for i, n in sizes if i == 0)
        for name in kinds:
            by = {}
            for x in rows:
                if not name or x["container_name"] == name:
                    by.setdefault(x["id"], []).append(x)
            assert {i: sum(x["n_tokens"] for x in v) for i, v in by.items()} == known
            cap = caps.get(name, 256)
            assert all(len(v) == max(1, -(-known[i] // cap)) for i, v in by.items())
        if kinds != {""}:
            used = [f["fill"] for f in fills if f["container_name"] == "large"]
            assert sum(used) / len(used) > 0.95
        groups = {}
        for f in fills:
            groups.setdefault(f["step_group"], []).append(f)
        assert all(len(g) <= packing.GROUP_WINDOWS for g in groups.values())


def test_tiers_pack_their_own_and_fill_longer_gaps():
    sizes = [90, 80, 30, 30, 9, 8, 7, 5, 4]
    got = packing.fill(sizes, [10, 40, 100], [100, 100, 100])
    assert [t for t, _ in got] == [2, 1, 0] and sorted(k for _, w in got for x in w for k in x) == list(range(9))
    by = {t: [[sizes[k] for k in x] for x in w] for t, w in got}
    assert by[2] == [[90, 9], [80, 8, 7, 5]] and by[1] == [[30, 30, 4]] and by[0] == []  # a 30 opens a window of its tier
    assert packing.fill([30, 4], [10, 40, 100], [10, 40, 100]) == [(2, []), (1, [[0, 1]]), (0, [])]


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "id long, n_tokens long"), {"c": 8}).count() == 0


def slow_sainte_lague(weights, seats):
    out = dict.fromkeys(weights, 0)
    for _ in range(seats):
        k = max(sorted(k for k in weights if weights[k] > 0), key=lambda k: weights[k] / (2 * out[k] + 1))
        out[k] += 1
    return out


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1001])
def test_apportion(seats):
    weights = {"a": 0.5, "b": 0.25, "c": 0.25, "d": 0.031, "e": 0.0}
    assert mixing.apportion(weights, seats) == slow_sainte_lague(weights, seats)


def test_mixing(spark):
    rows = [(f"a{k}", "a", 50 + k % 7) for k in range(800)] + [(f"b{k}", "b", 40) for k in range(100)] + [("x", "other", 10), ("y", None, 10), ("z", "a", None), (None, "a", 10), ("a1", "a", 51)]
    docs = spark.createDataFrame(rows, "id string, source string, n_tokens long").withColumn("quota", F.lit(1))
    goal = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 3), ("none", 0.1, 2), ("bad", None, 1)], "source string, target_share double, max_repeats int")
    for shard, bundle in ((4_000_000, 4096), (5000, 4096), (2000, 3)):
        drawn = mixing.mix(docs, goal, shard_tokens=shard, block_tokens=16, bundle=bundle)
        out = drawn.collect()
        assert {r["source"] for r in out} == {"a", "b"} and all(r["uses"] <= (1 if r["source"] == "a" else 3) for r in out)
        share = {r["source"]: r["actual_share"] for r in mixing.shares(drawn, goal).collect()}
        assert abs(share["a"] - 2 / 3) < 0.02 and abs(share["b"] - 1 / 3) < 0.02 and share["none"] == 0
        assert sum(r["uses"] * 40 for r in out if r["source"] == "b") > 11000
    assert mixing.mix(docs.limit(0), goal).count() == 0


def test_blocks_are_drawn_by_seed(spark):
    docs = spark.range(4000).select("id", F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"), F.lit(10).cast("long").alias("n_tokens"))
    goal = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    got = {seed: {r["id"] for r in mixing.mix(docs, goal, seed, block_tokens=200).where("source = 'a'").collect()} for seed in (1, 2)}
    assert all(abs(len(x) - 1000) <= 1 for x in got.values()) and got[1] != got[2] and len(got[1] & got[2]) < 600
    runs = sorted(got[1])
    assert sum(b - a > 1 for a, b in zip(runs, runs[1:])) > 200 and mixing.quotas({"a": {0: 0}}, {"a": (1.0, 1)}) == (1, [])


def test_token_counts(spark):
    rows = [(1, "hello world"), (2, ""), (3, None), (None, "x"), (1, "hello world"), (4, "naïve ☃ " * 3000)]
    got = dict(tuple(r) for r in tokens.token_counts(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect())
    e = tokens.encoding()
    assert got == {1: 2, 2: 0, 3: 0, 4: len(e.encode_ordinary("naïve ☃ " * 3000))} and e.decode(e.encode_ordinary("a b")) == "a b"


SENTENCES = "The children gathered around the bench and talked about the plum. She pointed to the seed and said it must have come from a tree. "
PAGES = {
    "repeat": ("cheap toy kit, buy set box, " * 20, True), "links": ("<a href='http://a.example/x'>toy kit sale</a>\n" * 12, True), "bare": ("http://a.test/p/1\nhttp://b.test/p/2\n" * 5, True),
    "shop": ("SKU 41216 - rounded echo USD 89.99 add to cart\nSKU 90511 - giant root only 96.99 in stock\n" * 4, True), "tags": (" ".join(f"#tag{k}toy" for k in range(40)), True),
    "door": ("Best bell kit Oakley - cheap bell kit Oakley bell kit online. Looking for bell kit in Quenby? Our bell kit Quenby is the top bell kit. Best bell kit Norvale - cheap bell kit Norvale bell kit online.", True),
    "talk": (SENTENCES * 6, False), "materials": (SENTENCES * 3 + "\nMaterials: wet shell, dry seed, big cork, old rope, red cup\n", False), "refrain": (SENTENCES + "\nThe plum goes round and round, round goes the plum." * 6, False),
    "some links": (SENTENCES * 3 + "\nFurther reading:\nhttp://a.test/p/1\nhttp://b.test/p/2\n", False), "words": ("Words of the week:\n" + "\n".join(f"- {w}" for w in THINGS) + "\n" + SENTENCES * 2, False),
    "empty": ("", False), "null": (None, False), "german": ("Warum glaubt ihr, dass wir das Eis besser sehen als den Frosch? Heute mischen wir den Schlamm mit Wasser. " * 5, False),
    "long": (SENTENCES * 2000, False), "long spam": ("buy toy set " * 20000, True),
}


def test_spam(spark):
    rows = [(k, t) for k, (t, _) in PAGES.items()] + [("repeat", PAGES["repeat"][0]), (None, "buy toy " * 50)]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("n_words", F.lit("x"))
    got = {r["id"]: r["spam"] for r in spam.scored(df, "id", "text").collect()}
    assert got == {k: v for k, (_, v) in PAGES.items()}
    assert spam.scored(df.limit(0), "id", "text").count() == 0


def test_lag_windows():
    import numpy as np

    assert spam.autocorrelation(np.array([1, 2, 3] * 10), 8) == 1.0 and spam.recurrence(np.array([1, 2, 3] * 10), 8) == 0.9
    assert spam.autocorrelation(np.arange(30), 8) == spam.recurrence(np.arange(30), 8) == 0.0


def test_runs_with_few_recurring_labels_are_no_spam():
    import random

    r = random.Random(2)
    pupils = iter(f"Pupil{k}" for k in range(99))
    roster = "\n".join(f"Table {r.choice(['red', 'blue', 'green', 'gold'])} " + " ".join(next(pupils) for _ in range(r.choice([1, 1, 2, 2]))) for _ in range(24))
    tags = " ".join(f"#{r.choice(THINGS)}{r.choice('abc')}" for _ in range(42))
    for text, spammy in ((roster, False), (tags, True)):
        n, _, _, found, again, periodic = spam.judge(text)
        codes = set(text.lower().replace("#", "").split())
        assert len(codes) < 0.6 * n and again < 0.5 and periodic < 0.3 and found == (n if spammy else 0)


def test_names_by_shares_and_context(spark):
    got = found(spark, [("once", "Please ask Tamsin about the wet shell."), ("says", "today Brenwick said the cork can float."), ("thing", "We saw Marble Bridge by the gate."), ("usual", "We saw the gate. We ask Shell by the shell, a shell, my shell.")])
    assert got["once"] == ("Please ask [NAME] about the wet shell.", ["name"]) and got["says"][1] == ["name"] and got["thing"][1] == got["usual"][1] == []


def test_lexicon_follows_shares(spark):
    texts = ["We told Orvan that a gate is here."] * 40 + ["We saw orvan by the Shell and gate."] * 3 + ["We drop a cork and gate by Velda."] * 2
    lex = pii.lexicon(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert lex.name("orvan") and not lex.usual("orvan") and lex.usual("gate") and lex.name("velda")
    detected = pii.detect("We saw Mr. Orvan by the gate.", lex)
    assert [k for _, _, k in detected] == ["name"]


def test_lexicon_does_not_raise_its_bar_with_the_number_of_texts(spark):
    df = spark.range(600_000).select(F.when(F.col("id") < 2, "We told Velda that a gate is here.").otherwise("gate").alias("text"))
    assert pii.lexicon(df).name("velda")


def test_tables_of_the_language_grow_with_its_words(spark):
    df = spark.createDataFrame([(f"word{k}a word{k}b word{k}c", f"We saw word{k}a and word{k}b.") for k in range(300)] * 3, "prompt string, reply string")
    model = defects.Model(word_slots=256, end_slots=256)
    reader = defects.Reader(defects.language(df, model), model)
    assert not any(reader.unknown(f"word{k}{c}") for k in range(300) for c in "abc")
    assert sum(reader.unknown(f"fremd{k}") for k in range(1000)) > 900
    assert (reader.lang.seen > 0).mean() <= 0.25 and reader.lang.prefixes.mean() < 0.1
