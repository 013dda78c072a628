"""Near-duplicate records: a MinHash LSH forest over word sets with exact verification.

Texts become sets of distinct words; equal sets form one class, which a task puts into the forest once however many
copies it reads, so copies never meet pair by pair. Each of the ``trees`` is a trie of the classes' MinHash
signatures, kept as rows sorted by their prefixes. Prefixes are as short as the target recall demands: ``depth``
values, at which ``trees`` trees find a pair at the threshold itself with at least ``target_recall``, and closer ones
more surely. Where a node holds more than ``crowd`` classes its prefix stays longer instead: the members get ``depth``
further values in ``trees`` tries of their own, which reach the target again, and so on down to ``levels``; what then
is still crowded (texts alike in nearly every word) meets in pairs of blocks of bounded size. No class, candidate or
partner is left out. A class that stays crowded in all its tries costs trees ** (levels + 1) rows, fewer than
the ``crowd`` partners that it then has in each of them.

A class meets at most ``crowd`` others per node, so work follows the number of classes, however common a
prefix is; a node of any size is read as a stream. Members of a node first pass lossless tests on sizes and sketches:
sets of a and b words with similarity s or more differ in at most (a + b)(1 - s)/(1 + s) words, and their parity
sketches in at most as many bits. What is left is verified exactly on the word sets. Words move for candidates only.

Defined results: rows without id or text take no part, nor do texts with fewer than ``min_words`` distinct words;
a repeated id counts once; an empty table gives empty results; whole texts are read, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..plans.runtime import written
from .families import spanning_forest
from .words import WordHashes, parity_sketch, words

_SIZE_BITS = 8
_SEEN = 1_000_000
_SMALL = 48
#: The candidate classes are broadcast up to this many rows of 8 bytes; beyond it they are joined by shuffle.
BROADCAST_ROWS = 2_000_000


@dataclass(frozen=True)
class Forest:
    threshold: float = 0.8
    min_words: int = 8
    depth: int = 4
    target_recall: float = 0.9995
    crowd: int = 4096
    levels: int = 2
    seed: int = 11

    @property
    def trees(self) -> int:
        """As many as find a pair at the threshold with the target recall."""
        return max(1, int(np.ceil(np.log(1 - self.target_recall) / np.log(1 - self.threshold**self.depth) - 1e-9)))

    def functions(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed + 1000 * level)
        return tuple(rng.integers(1, 2**62, (self.trees, self.depth), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def _word_sets(min_words: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, texts, digests = [], [], []
            for i, text in zip(b["id"], b["text"]):
                own = set(words(text))
                if len(own) >= min_words:
                    ids.append(i)
                    texts.append(" ".join(sorted(own)))
                    digests.append(xxhash.xxh3_128_digest(texts[-1]))
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pd.DataFrame({"id": pd.Series(ids, dtype=object), "h": both[:, 0], "g": both[:, 1], "words": pd.Series(texts, dtype=object)})

    return run


def word_sets(df: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(id, h, g, words): the sorted distinct words of each text and 128 bits of their hash."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    return rows.mapInPandas(_word_sets(min_words), "id string, h long, g long, words string")


def _signatures(flat: np.ndarray, starts: np.ndarray, forest: Forest, level: int) -> np.ndarray:
    """(sets, trees): the prefix of each set in each tree of a level, its values in 16 bits each from the first on."""
    factors, mixers = forest.functions(level)
    keys = np.zeros((len(starts), forest.trees), np.uint64)
    for t in range(forest.trees):
        for d in range(forest.depth):
            spread = flat * factors[t, d]
            spread ^= spread >> np.uint64(29)
            spread *= mixers[t, d]
            least = np.minimum.reduceat(spread, starts) * np.uint64(0x9E3779B97F4A7C15)
            keys[:, t] = (keys[:, t] << np.uint64(16)) | (least >> np.uint64(48))
    return keys


def _signed(forest: Forest, level: int):
    """Rows (tree, node, key, h, sketch): each class under its prefix, below the node that it comes from."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, seen = WordHashes(), set()
        for b in batches:
            if not level:  # copies enter once
                b = b.drop_duplicates(["h", "g"])
                own = list(zip(b["h"], b["g"]))
                b = b[[x not in seen for x in own]]
                if len(seen) > _SEEN:
                    seen.clear()
                seen.update(own)
            if not len(b):
                continue
            sets = [w.split(" ") for w in b["words"]]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            flat = np.fromiter((known[w] for s in sets for w in s), np.uint64, int(sizes.sum()))
            sketch = (parity_sketch(flat, starts) & ~np.uint64(2**_SIZE_BITS - 1)) | np.minimum(sizes, 255).astype(np.uint64)
            keys = _signatures(flat, starts, forest, level)
            n = forest.trees
            node = b["node"].to_numpy() if level else np.zeros(len(b), np.int64)
            yield pd.DataFrame({
                "tree": np.tile(np.arange(n, dtype=np.int8), len(b)), "node": np.repeat(node, n), "key": keys.ravel().view(np.int64), "h": np.repeat(b["h"].to_numpy(), n), "sketch": np.repeat(sketch.view(np.int64), n)})

    return run


def _near(x: np.ndarray, y: np.ndarray, forest: Forest) -> np.ndarray:
    """Which pairs of sketches may belong to similar sets; both tests never reject a similar pair."""
    m, n = (x & np.uint64(255)).astype(np.int32), (y & np.uint64(255)).astype(np.int32)
    slack = np.float32((1 - forest.threshold) / (1 + forest.threshold))
    ok = np.bitwise_count((x ^ y) >> np.uint64(_SIZE_BITS)) <= (m + n) * slack + np.float32(1e-3)
    ok &= np.minimum(m, n) >= np.float32(forest.threshold) * np.maximum(m, n) - np.float32(1e-3)
    return ok | (m == 255) | (n == 255)


def _meetings(h: np.ndarray, sketch: np.ndarray, first: np.ndarray, forest: Forest) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs within nodes that pass the tests; ``first`` marks where a node begins."""
    starts = np.flatnonzero(first)
    sizes = np.diff(np.concatenate([starts, [len(h)]]))
    small = np.repeat(sizes <= _SMALL, sizes)
    hs, ss, node = h[small], sketch[small], np.repeat(np.arange(len(sizes)), sizes)[small]
    at = np.arange(len(hs))
    for k in range(1, _SMALL):
        at = at[at + k < len(hs)]
        at = at[node[at] == node[at + k]]
        if not len(at):
            break
        ok = at[_near(ss[at], ss[at + k], forest)]
        yield hs[ok], hs[ok + k]
    for a, n in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist()):
        for k in range(0, n, 128):
            rows = np.arange(k, min(k + 128, n))
            ok = _near(sketch[a + rows][:, None], sketch[None, a + k : a + n], forest)
            i, j = np.nonzero(ok)
            later = j > i
            yield h[a + k + i[later]], h[a + k + j[later]]


def _met(forest: Forest, crowd: float):
    """Candidates (h, k) of sorted (tree, node, key, h, sketch), and (h, node) of the members of crowded nodes."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        crowded = None  # the node that is too large, as long as its rows come

        def out(x: np.ndarray, y: np.ndarray | None, node: np.ndarray | None) -> pd.DataFrame:
            none = pd.array([None] * len(x), dtype="Int64")
            low, high = (x, none) if y is None else (np.minimum(x, y), np.maximum(x, y))
            return pd.DataFrame({"h": low, "k": high, "node": none if node is None else node})

        def names(rows: list[np.ndarray]) -> np.ndarray:
            mixed = (rows[2].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ rows[1].view(np.uint64) ^ (rows[0].astype(np.uint64) << np.uint64(57))
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)

        def done(rows: list[np.ndarray]) -> Iterator[pd.DataFrame]:
            same = np.ones(len(rows[0]) - 1, bool)
            for c in rows[:3]:
                same &= c[1:] == c[:-1]
            again = np.concatenate([[False], same & (rows[3][1:] == rows[3][:-1])])  # a class put in by several tasks
            first = np.concatenate([[True], ~same])[~again]
            rows = [c[~again] for c in rows]
            sizes = np.diff(np.concatenate([np.flatnonzero(first), [len(first)]]))
            large = np.repeat(sizes > crowd, sizes)
            if large.any():
                yield out(rows[3][large], None, names([c[large] for c in rows]))
            for x, y in _meetings(rows[3][~large], rows[4][~large].view(np.uint64), first[~large], forest):
                if len(x):
                    yield out(x, y, None)

        for b in batches:
            rows = [b[c].to_numpy() for c in ("tree", "node", "key", "h", "sketch")]
            if crowded is not None:
                go_on = np.logical_and.reduce([c == v for c, v in zip(rows[:3], crowded)])
                if go_on.any():
                    yield out(rows[3][go_on], None, names([c[go_on] for c in rows]))
                rows = [c[~go_on] for c in rows]
                crowded = crowded if go_on.all() else None
            held = [np.concatenate(c) for c in zip(held, rows)] if held else rows
            if not len(held[0]):
                continue
            last = np.logical_and.reduce([c == c[-1] for c in held[:3]])
            begin = int(np.flatnonzero(last)[0])  # sorted, so the last node's rows end the batch
            if begin:
                yield from done([c[:begin] for c in held])
                held = [c[begin:] for c in held]
            if len(held[0]) > 2 * crowd + 10_000:  # beyond repeats, crowded for sure
                crowded = tuple(c[-1] for c in held[:3])
                yield out(held[3], None, names(held))
                held = []
        if held and len(held[0]):
            yield from done(held)

    return run


_ROWS, _OUT = "tree byte, node long, key long, h long, sketch long", "h long, k long, node long"


def _met_in(rows: DataFrame, forest: Forest, crowd: float, name: str) -> DataFrame:
    dealt = rows.repartition("tree", "node", "key").sortWithinPartitions("tree", "node", "key", "h")
    return written(dealt.mapInPandas(_met(forest, crowd), _OUT).distinct(), name)


def _in_blocks(crowded: DataFrame, forest: Forest) -> DataFrame:
    """Members (h, node, sketch) under one key for each pair of blocks of their node that their own block is in."""
    block = max(1, forest.crowd // 2)
    sizes = crowded.groupBy("node").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = crowded.join(sizes, "node").withColumn("own", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return rows.select(F.lit(0).cast("byte").alias("tree"), "node", F.shiftleft(low.cast("long"), 32).bitwiseOR(high.cast("long")).alias("key"), "h", "sketch")


def candidates(sets: DataFrame, forest: Forest) -> DataFrame:
    """(h, k) of classes that may be similar, from (h, g, words) with any number of rows per class."""
    rows = sets.select("h", "g", "words").mapInPandas(_signed(forest, 0), _ROWS)
    found = None
    for level in range(forest.levels + 1):
        last = level == forest.levels
        met = _met_in(rows, forest, float("inf") if last else forest.crowd, "nodes")
        pairs = met.where("k is not null").select("h", "k")
        found = pairs if found is None else found.union(pairs)
        crowded = met.where("k is null").select("h", "node")
        if last or not crowded.limit(1).count():
            return found.distinct() if level else found
        below = crowded.join(sets.select("h", "g", "words").dropDuplicates(["h", "g"]), "h").mapInPandas(_signed(forest, level + 1), _ROWS)
        if level == forest.levels - 1:
            below = _in_blocks(below.where("tree = 0").select("h", "node", "sketch"), forest)
        rows = below


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    pairs = written(pairs, "candidates")
    ends = pairs.select("h").union(pairs.select("k")).distinct()
    ends = F.broadcast(ends) if pairs.count() <= BROADCAST_ROWS // 2 else ends
    some = written(sets.select("h", "g", "words").join(ends, "h", "left_semi").dropDuplicates(["h", "g"]), "candidate-words")
    left = some.select("h", F.col("g").alias("hg"), F.col("words").alias("v"))
    right = some.select(F.col("h").alias("k"), F.col("g").alias("kg"), F.col("words").alias("w"))
    v, w = F.split("v", " "), F.split("w", " ")
    both = pairs.join(left, "h").join(right, "k").select("h", "hg", "k", "kg", F.size(F.array_intersect(v, w)).alias("shared"), (F.size(v) + F.size(w)).alias("total"))
    sim = F.col("shared") / (F.col("total") - F.col("shared"))
    return both.select("h", "hg", "k", "kg", sim.alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)


def links(sets: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """(h, hg, k, kg, similarity) between different word sets, from (h, g, words) with any number of rows per set."""
    return written(_verified(candidates(sets, forest), sets, forest.threshold), "links")


@dataclass
class NearDuplicates:
    members: DataFrame  #: (id, h, g): the class of each record
    links: DataFrame  #: (h, hg, k, kg, similarity)
    forest: Forest

    def recall(self) -> DataFrame:
        """One row (n_links, recall): the recall of the first level that the similarities of the links speak for.

        A link found with probability p stands for 1 / p links; without links the recall is that at the threshold.
        """
        f = self.forest
        p = F.lit(1.0) - F.pow(F.lit(1.0) - F.pow("similarity", F.lit(f.depth)), F.lit(f.trees))
        floor = 1 - (1 - f.threshold**f.depth) ** f.trees
        return self.links.agg(F.count("*").alias("n_links"), F.coalesce(F.count("*") / F.sum(1.0 / p), F.lit(floor)).alias("recall"))


def near_duplicates(records: DataFrame, id_col: str = "id", text_col: str = "text", forest: Forest = Forest()) -> NearDuplicates:
    sets = written(word_sets(records, id_col, text_col, forest.min_words), "sets")
    return NearDuplicates(sets.select("id", "h", "g").dropDuplicates(["id"]), links(sets, forest), forest)


def pairs(found: NearDuplicates) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of records of one class or of linked classes."""
    a, b = found.members.select(F.col("id").alias("i"), "h", "g"), found.members.select(F.col("id").alias("j"), F.col("h").alias("k"), F.col("g").alias("kg"))
    within = a.join(b, (F.col("h") == F.col("k")) & (F.col("g") == F.col("kg")) & (F.col("i") < F.col("j"))).select("i", "j")
    across = found.links.select("h", F.col("hg").alias("g"), "k", "kg").join(a, ["h", "g"]).join(b, ["k", "kg"]).select("i", "j")
    both = within.union(across)
    return both.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))


def groups(found: NearDuplicates) -> DataFrame:
    """(id, group_id, class_id, n_links): the connected group of each record that has a copy or a linked class.

    ``n_links`` counts the linked classes; copies share class and group. Group ids are the least class hash, 128 bits in hex.
    """
    def name(h: str, g: str) -> F.Column:
        return F.concat(F.lpad(F.hex(h), 16, "0"), F.lpad(F.hex(g), 16, "0"))

    ends = found.links.select(name("h", "hg").alias("a"), name("k", "kg").alias("b"))
    _, labels = spanning_forest(ends)
    degree = ends.select(F.col("a").alias("class_id")).union(ends.select("b")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    sizes = found.members.groupBy("h", "g").agg(F.count("*").alias("copies"))
    rows = found.members.join(sizes, ["h", "g"]).select("id", name("h", "g").alias("class_id"), "copies")
    rows = rows.join(degree, "class_id", "left").join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
    return rows.where("copies > 1 or n_links is not null").select("id", F.coalesce("root", "class_id").alias("group_id"), "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
