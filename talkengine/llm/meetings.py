"""Similar word sets of two sides by the rarest words that they share, for sides of any size.

Exactness. Words have one order, rarest first. A set of n words that is similar to one of at least t n words has at most
(1 - t) n words of its own, and at most n (1 - t) / (1 + t) if the other is no smaller. So the first ``depth`` common
words of a similar pair stand in either set behind no more skipped words than that, and both sets are found under the
first common word, under the first two and so on. A set goes to the groups of its rarest words only, with the words
behind. In a group it goes on to the subgroups of the next words that it may skip to, as long as a group holds more
pairs than a further word costs; the pairs of small groups are compared by sketch and size. Whatever word a group ends
at, no similar pair is left out, so how often words occur and where groups end changes the work and not the result.
Sets with equal folded text meet by that. A pair is named by its sketches; the caller verifies it on the words.

Scale: a set moves once for each of (1 - t) n + 1 words. Evaluation sets of a word that holds more than ``block`` of
them are dealt to blocks that all training sets of the word meet, so a task holds one block and streams the rest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .words import WordHashes

#: Training rows that a task takes at a time, rows of subgroups made at a time, and the pairs a row for which one more word pays.
CHUNK, WIDE, PAYS = 200_000, 1_000_000, 24
DEPTH = 5
#: Sets of more words meet at their first common word; the words behind would grow as the square of the size.
LONG = 400
_SEEN, _WORDS = 300_000, 1_000_000
_FOLD, _LONG = 0xFFFF, 0xFFFE  #: in place of the skipped words in rows that meet by folded text, and in those of long sets
_HEAD = 6  #: two-byte units before the words of a row: sketch, size, skipped words


def depth(threshold: float, min_words: int) -> int:
    """Common words that every similar pair has, DEPTH at most."""
    return max(1, min(DEPTH, int(np.ceil(threshold * min_words - 1e-9))))


def own_words(n: np.ndarray, threshold: float, smaller: bool) -> np.ndarray:
    """Words that a set of n at most has for itself in a similar pair; smaller: the other is no smaller."""
    return np.floor(n * (1 - threshold) / (1 + threshold * smaller) + 1e-9).astype(np.int64)


def _spread(counts: np.ndarray) -> np.ndarray:
    """0 to c - 1 for each count c."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


# ---------------------------------------------------------------- rows


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches without what came a moment before, in parts of about _WORDS words."""
    seen: set[int] = set()
    for b in batches:
        at, size = [], 0
        for k, (train, h, n) in enumerate(zip(b["train"].to_pylist(), b["h"].to_pylist(), pc.binary_length(b["words"]).to_pylist())):
            if (x := 2 * h + train) not in seen:
                seen.add(x)
                at.append(k)
                size += n
            if size > 6 * _WORDS:
                yield b.take(pa.array(at))
                at, size = [], 0
        if at:
            yield b.take(pa.array(at))
        if len(seen) > _SEEN:
            seen.clear()


def _rows(hashes: np.ndarray, counts: np.ndarray, threshold: float, deep: int, block: int):
    """key (group, then side) and data of (train, h, fold, sketch, n, words); counts of the frequent words by sorted hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in _parts(batches):
            codes: dict[str, int] = {}
            runs = [w.split(" ") for w in b["words"].to_pylist()]
            flat = np.fromiter((codes.setdefault(w, len(codes)) for r in runs for w in r), np.int64)
            names = list(codes)
            hashed = np.fromiter((known[w] for w in names), np.uint64, len(names))
            spot = np.minimum(np.searchsorted(hashes, hashed), max(0, len(hashes) - 1))
            often = np.where(hashes[spot] == hashed, counts[spot], 0) if len(hashes) else np.zeros(len(names), np.int64)
            order = np.array([k for *_, k in sorted(zip(often.tolist(), hashed.tolist(), names, range(len(names))))])
            rank = np.empty(len(names), np.int64)
            rank[order] = np.arange(len(names))
            once = np.unique(np.repeat(np.arange(len(runs)), [len(r) for r in runs]) * len(names) + rank[flat])
            text, word = once // len(names), order[once % len(names)]
            n = np.bincount(text, minlength=len(runs))
            starts = np.cumsum(n) - n
            symbol = (_mixed(hashed) & np.uint64(0xFFFF)).astype(np.uint16)[word]
            own = own_words(n, threshold, False)
            held = np.minimum(n, own + deep)

            short, long = np.flatnonzero(n <= LONG), np.flatnonzero(n > threshold * LONG)
            count = np.minimum(own + 1, held)
            which, skipped = np.repeat(np.concatenate([short, long]), count[np.concatenate([short, long])]), _spread(count[np.concatenate([short, long])])
            first = word[starts[which] + skipped]
            apart = np.arange(len(which)) >= count[short].sum()
            skipped[apart] = _LONG
            train = b["train"].to_numpy(zero_copy_only=False)
            sketch = b["sketch"].to_numpy()
            blocks = np.maximum(1, -(-often[first] // block))
            copies = np.where(train[which], blocks, 1)  # training sets meet every block of the word
            dealt = np.repeat(np.where(train[which], 0, _mixed(sketch.view(np.uint64)[which]) % blocks.astype(np.uint64)).astype(np.int64), copies) + _spread(copies)
            which, skipped, first, apart = (np.repeat(x, copies) for x in (which, skipped, first, apart))
            group = _mixed(hashed[first] + (2 * dealt + apart).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)

            tail = np.where(apart, 0, held[which] - skipped - 1)
            which, skipped, tail = (np.concatenate(x) for x in ((which, np.arange(len(runs))), (skipped, np.full(len(runs), _FOLD)), (tail, np.full(len(runs), 4))))
            fold = b["fold"].to_numpy()
            group = np.concatenate([group, _mixed(fold.view(np.uint64)) >> np.uint64(32)]).astype(np.int64)
            offset = np.concatenate([[0], np.cumsum(tail + _HEAD)])
            data = np.zeros(int(offset[-1]), np.uint16)
            begin = offset[:-1]
            data[begin[:, None] + np.arange(4)] = sketch[which].view(np.uint16).reshape(-1, 4)
            data[begin + 4] = np.minimum(n, 0xFFFF)[which]
            data[begin + 5] = skipped
            words = slice(0, len(which) - len(runs))
            t = tail[words]
            data[np.repeat(begin[words] + _HEAD, t) + _spread(t)] = symbol[np.repeat(starts[which[words]] + skipped[words] + 1, t) + _spread(t)]
            data[begin[words.stop :, None] + _HEAD + np.arange(4)] = fold.view(np.uint16).reshape(-1, 4)
            binary = pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer((offset * 2).astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(group * 2 + train[which]), binary], ["key", "data"])

    return run


# ---------------------------------------------------------------- groups


class Held:
    """Rows of whole groups, evaluation rows first in each."""

    def __init__(self, rows: pa.Table, threshold: float, deep: int, hits: int) -> None:
        self.threshold, self.deep, self.hits = threshold, deep, hits
        key = rows["key"].to_numpy()
        data = rows["data"].combine_chunks() if isinstance(rows["data"], pa.ChunkedArray) else rows["data"]
        data = pa.concat_arrays(data.chunks) if isinstance(data, pa.ChunkedArray) else data
        offset = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64) // 2
        self.units = np.frombuffer(data.buffers()[2], np.uint16)
        begin = offset[:-1]
        self.sketch = self.units[begin[:, None] + np.arange(4)].view(np.uint64).reshape(-1)
        self.n, self.skipped = self.units[begin + 4].astype(np.int64), self.units[begin + 5].astype(np.int64)
        self.words, self.tail = begin + _HEAD, np.diff(offset) - _HEAD
        self.group, self.train = key >> 1, (key & 1).astype(bool)
        self.slack = (self.n * ((1 - threshold) / (1 + threshold)) + 5e-4).astype(np.float32)
        self.found: list[np.ndarray] = []

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sketches of the training and evaluation sets that may be similar."""
        folds = np.flatnonzero(self.skipped == _FOLD)
        if len(folds):
            value = self.units[self.words[folds][:, None] + np.arange(4)].view(np.uint64).reshape(-1)
            _, same = np.unique(value, return_inverse=True)
            self._compare(*self._grouped(folds, same)[:2], None, False)
        long = np.flatnonzero(self.skipped == _LONG)
        self._compare(*self._grouped(long, self.group[long])[:2], None)
        rows = np.flatnonzero(self.skipped < _LONG)
        key = np.unique(self.group[rows], return_inverse=True)[1] * 2
        parts = []
        for side in (0, 1):  # the training set is no smaller, the evaluation set is no smaller
            limit = np.where(self.train[rows] == bool(side), own_words(self.n[rows], self.threshold, True), own_words(self.n[rows], self.threshold, False))
            some = self.skipped[rows] <= limit
            parts.append((rows[some], np.full(int(some.sum()), -1), (limit - self.skipped[rows])[some], key[some] + side))
        self._step(*(np.concatenate(x) for x in zip(*parts)), 1)
        if not self.found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = np.unique(np.concatenate(self.found), axis=0)
        return both[:, 0], both[:, 1]

    def _grouped(self, rows: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order by group and side, the bounds of (evaluation rows, training rows, next group), and which groups have both."""
        order = np.argsort(key * 2 + self.train[rows], kind="stable")
        ordered = key[order]
        begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else np.empty(0, np.int64)
        end = np.concatenate([begin[1:], [len(order)]]).astype(np.int64)[: len(begin)]
        passed = np.concatenate([[0], np.cumsum(self.train[rows[order]])])
        trained = passed[end] - passed[begin]
        bounds = np.stack([begin, end - trained, end], 1)
        return rows[order], bounds[(trained > 0) & (end - trained > begin)], order

    def _compare(self, rows: np.ndarray, bounds: np.ndarray, some: np.ndarray | None, near: bool = True) -> None:
        """Pairs of the evaluation and training rows of each group, about ``hits`` at a time."""
        bounds = bounds if some is None else bounds[some]
        size, each = bounds[:, 1] - bounds[:, 0], bounds[:, 2] - bounds[:, 1]
        t = rows[np.repeat(bounds[:, 1], each) + _spread(each)]
        first, count = np.repeat(bounds[:, 0], each), np.repeat(size, each)
        total, at = np.cumsum(count), 0
        sketch, slack = self.sketch[rows], self.slack[rows]
        while at < len(t):
            cut = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + self.hits, "right")))
            c = count[at:cut]
            e = _spread(c) + np.repeat(first[at:cut], c)
            q = np.repeat(np.arange(at, cut), c)
            if near:
                left, room = self.sketch[t[at:cut]], self.slack[t[at:cut]]
                ok = np.flatnonzero(np.bitwise_count(np.repeat(left, c) ^ sketch[e]) <= np.repeat(room, c) + slack[e])
                q, e = q[ok], e[ok]
            x, y = t[q], rows[e]
            if near:
                n, m = self.n[x], self.n[y]
                ok = (np.minimum(n, m) >= self.threshold * np.maximum(n, m) - 1e-9) | (np.maximum(n, m) == 0xFFFF)
                x, y = x[ok], y[ok]
            if len(x):
                self.found.append(np.unique(np.stack([self.sketch[x], self.sketch[y]], 1).view(np.int64), axis=0))
            at = cut

    def _step(self, rows: np.ndarray, place: np.ndarray, left: np.ndarray, key: np.ndarray, level: int) -> None:
        """Compares small groups and parts the others by the next word; place: of the last word behind the first, left: words that may still be skipped."""
        rows, bounds, order = self._grouped(rows, key)
        e, t = bounds[:, 1] - bounds[:, 0], bounds[:, 2] - bounds[:, 1]
        last = (e * t <= PAYS * (e + t)) | (level == self.deep)
        self._compare(rows, bounds, last)
        bounds = bounds[~last]
        if not len(bounds):
            return
        place, left = place[order], left[order]
        size = bounds[:, 2] - bounds[:, 0]
        at, group = np.repeat(bounds[:, 0], size) + _spread(size), np.repeat(np.arange(len(size)), size)
        fan = np.maximum(0, np.minimum(left[at], self.tail[rows[at]] - place[at] - 2) + 1)
        total = np.cumsum(np.bincount(group, fan, len(size)))
        till, edge, begin = np.concatenate([[0], np.cumsum(size)]), 0, 0
        while begin < len(size):
            cut = max(begin + 1, int(np.searchsorted(total, edge + WIDE, "right")))
            part = slice(till[begin], till[cut])
            f = fan[part]
            more, who = _spread(f), np.repeat(at[part], f)
            next_place = place[who] + 1 + more
            symbol = self.units[self.words[rows[who]] + next_place].astype(np.int64)
            self._step(rows[who], next_place, left[who] - more, np.repeat(group[part], f) * 65536 + symbol, level + 1)
            edge, begin = total[cut - 1], cut


def _met(threshold: float, deep: int, hits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            if rows.num_rows:
                x, y = Held(rows, threshold, deep, hits).pairs()
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["ts", "es"])

        held: list[pa.RecordBatch] = []
        size, kept = 0, 0  # rows, and those of them that were compared already and wait for more training rows
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < max(2 * kept, kept + CHUNK):
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            key = rows["key"].to_numpy()
            begin = int(np.searchsorted(key, key[-1] >> 1 << 1))
            trained = int(np.searchsorted(key, key[-1] | 1))
            if begin:
                yield from found(rows.slice(0, begin))
                rest, kept = rows.slice(begin), 0
            elif trained < len(key):  # one group: its evaluation rows stay
                yield from found(rows)
                rest, kept = rows.slice(0, trained), trained
            else:
                rest, kept = rows, len(key)
            held, size = rest.to_batches(), rest.num_rows
        if size:
            yield from found(pa.Table.from_batches(held).combine_chunks())

    return run


def candidates(evaluation: DataFrame, train: DataFrame, threshold: float, min_words: int, block: int, hits: int) -> DataFrame:
    """(ts, es): sketches of training and evaluation sets that hold all similar pairs and all of equal folded text.

    Both sides are (h, fold, sketch, n, words), words between blanks; repeated rows are allowed.
    """
    deep = depth(threshold, min_words)
    words = evaluation.select(F.explode(F.array_distinct(F.split("words", " "))).alias("word"))
    least = max(1, min(evaluation.count() // 5000, block))  # so the driver gets some 5000 x words per text at most
    often = words.groupBy("word").count().where(F.col("count") > least).collect()
    known = WordHashes()
    hashes, counts = np.array([known[r["word"]] for r in often], np.uint64), np.array([r["count"] for r in often], np.int64)
    order = np.argsort(hashes)
    columns = ["h", "fold", "sketch", "words"]
    both = evaluation.select(F.lit(False).alias("train"), *columns).union(train.select(F.lit(True).alias("train"), *columns))
    rows = both.mapInArrow(_rows(hashes[order], counts[order], threshold, deep, block), "key long, data binary")
    dealt = rows.repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    return dealt.mapInArrow(_met(threshold, deep, hits), "ts long, es long").distinct()
