"""Overlaps of evaluation splits of many shards: the groups of rarest words against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from talkengine.llm import meetings, overlaps
from talkengine.llm.words import WordHashes, parity_sketch

VOCABULARY = [f"w{k}" for k in range(60)]


def texts(seed, n, least, most, vocabulary=VOCABULARY):
    r = random.Random(seed)
    out = [r.sample(vocabulary, r.randint(least, most)) for _ in range(n)]
    for k in range(n):  # as near as the threshold allows, and a little beyond
        t, d = list(out[k]), max(1, len(out[k]) // 5)
        kind = r.randrange(4)
        t = t[d:] if kind == 0 else t + [f"x{k}y{j}" for j in range(len(t) // 4 + r.randrange(2))] if kind == 1 else t[: len(t) - d // 2] + r.sample(vocabulary, d // 2) if kind == 2 else r.sample(t, len(t))
        out.append(t)
    r.shuffle(out)
    return [" ".join(dict.fromkeys(t)) for t in out if len(set(t)) >= 8]


def met(sides, block=10**6, threshold=0.8):
    """The pairs of (training, evaluation) texts that come up, and the number of compared pairs."""
    known, rows = WordHashes(), []
    for train, side in ((False, sides[1]), (True, sides[0])):
        for k, t in enumerate(side):
            h = np.array([known[w] for w in sorted(set(t.split()))], np.uint64)
            rows.append({"train": train, "h": k, "fold": hash(t.replace(" ", "")) // 2, "sketch": int(parity_sketch(h, np.array([0])).view(np.int64)[0]), "words": t})
    schema = pa.schema([("train", pa.bool_()), ("h", pa.int64()), ("fold", pa.int64()), ("sketch", pa.int64()), ("words", pa.string())])
    counts = {}
    for t in sides[1]:
        for w in t.split():
            counts[known[w]] = counts.get(known[w], 0) + 1
    often = sorted((h, c) for h, c in counts.items() if c > 1)
    deep = meetings.depth(threshold, 8)
    split = [pa.RecordBatch.from_pylist(rows[k : k + 70], schema) for k in range(0, len(rows), 70)]
    made = meetings._rows(np.array([h for h, _ in often], np.uint64), np.array([c for _, c in often], np.int64), threshold, deep, block)
    table = pa.Table.from_batches(list(made(iter(split)))).sort_by("key")
    pairs = {(x, y) for b in meetings._met(threshold, deep, 500)(iter(table.to_batches(max_chunksize=90))) for x, y in zip(b["ts"].to_pylist(), b["es"].to_pylist())}
    of = lambda train: {(r["h"], r["sketch"]) for r in rows if r["train"] == train}
    by = {}
    for k, s in of(False):
        by.setdefault(s, []).append(k)
    return {(k, j) for k, s in of(True) for x, y in pairs if x == s for j in by[y]}


@pytest.mark.parametrize("kind", ["as they are", "deep", "small chunks", "blocks", "long", "long and short"])
@pytest.mark.parametrize("seed", [1, 2])
def test_every_similar_pair_comes_up(monkeypatch, kind, seed):
    if kind != "as they are":
        monkeypatch.setattr(meetings, "PAYS", 0 if kind == "deep" else 2)
        monkeypatch.setattr(meetings, "WIDE", 50)
    if kind == "small chunks":
        monkeypatch.setattr(meetings, "CHUNK", 20)
    if kind.startswith("long"):
        monkeypatch.setattr(meetings, "LONG", 5 if kind == "long" else 20)
    all_texts = texts(seed, 90, 8, 38)
    sides = all_texts[::2], all_texts[1::2]
    got = met(sides, 7 if kind == "blocks" else 10**6)
    sets = [[set(t.split()) for t in side] for side in sides]
    want = {(i, j) for i, a in enumerate(sets[0]) for j, b in enumerate(sets[1]) if len(a & b) >= 0.8 * len(a | b) - 1e-12}
    assert want <= got and len(want) > 15


def test_groups_are_parted_where_they_are_crowded(monkeypatch):
    """Twice the texts of one vocabulary must not mean four times the compared pairs."""
    compared = []
    real = meetings.Held._compare

    def counting(self, rows, bounds, some, near=True):
        b = bounds if some is None else bounds[some]
        compared[-1] += int(((b[:, 1] - b[:, 0]) * (b[:, 2] - b[:, 1])).sum())
        return real(self, rows, bounds, some, near)

    monkeypatch.setattr(meetings.Held, "_compare", counting)
    vocabulary = [f"v{k}" for k in range(200)]
    for n in (1000, 4000):
        compared.append(0)
        r = random.Random(3)
        some = [" ".join(r.sample(vocabulary, 20)) for _ in range(n)]
        met((some[::2], some[1::2]))
    assert 0 < compared[1] < 10 * compared[0]


def test_many_shards_need_no_search_of_each(spark, monkeypatch):
    def never(*_):
        raise AssertionError("training texts would stream through every shard")

    monkeypatch.setattr(overlaps, "build_index", never)
    some = texts(5, 60, 8, 30)
    rows = [(f"{k:03d}", "s", "train" if k % 2 else "val", t) for k, t in enumerate(some)]
    rows += [("j1", "s", "train", "today we all put the ice cream next to that warm lamp"), ("j2", "s", "test", "today we all put the icecream next to that warm lamp")]
    df = spark.createDataFrame(rows, "id string, source string, split string, text string")
    got = {(x["train_id"], x["eval_id"]) for x in overlaps.overlaps(df, overlaps.Search(shard_words=100)).collect()}
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b) - 1e-12
    want = {(a, b) for a, _, s, t in rows for b, _, z, u in rows if s == "train" and z != "train" and near(set(t.split()), set(u.split()))}
    assert got == want | {("j1", "j2")} and len(want) > 10
