"""Records of evaluation splits that also stand, equally or almost, in the training split.

Evaluation splits of more than ``shard_words`` words meet the training texts in the groups of their rarest words, see
``meetings``; the rest of this text is about smaller ones, of one shard.

The distinct texts of the evaluation splits are dealt to shards of bounded size; each shard becomes a compressed
full-text index (suffix array, Burrows-Wheeler symbol lists, zstd) in the shared folder. Texts are laid out in one
canonical order of their distinct words, rarest first, so texts that hold the same words in another order match too.
Training texts stream through every shard in blocks: backward search gives the rows of each run of two neighbouring
words, and the occurrences that the word before does not extend are the beginnings of the maximal matches. Matches
of one pair of texts are merged; what passes the lossless bounds on sizes and sketches is verified on the word sets.

Exactness. Let c words be common and d differ; similarity t or more means d <= c (1 - t) / t. Among the first d + 2
common words there are d + 1 gaps and at most d words that could part them, so two are neighbours in both texts, and
they lie within the first ``zone`` places of either. So every similar pair has a maximal match that begins in the zones, which is all
that is laid out; the other words stand beside the index for the verification. How often a run occurs, how texts are
dealt to shards and the blocks don't change the result. Texts with equal folded text meet by that.

Scale: a shard holds at most ``shard_words`` words, however large the evaluation splits are, and a block as many
words of training texts, so a shard is opened once for about as much work as it holds; memory is one block and one
shard. Work grows with training words times shards, so only one shard is searched this way. Copies are indexed once, searched once per block and expanded at
the end. Only (shard, size) rows come to the driver, which makes sure that it sees every shard file; a task that does
not find one fails.

``matched_words`` are the training words within maximal matches of ``short`` or more words in reading order,
``spans`` the stretches they form; equal folded texts match as a whole.

Defined results: rows without id or text, without a split and with fewer than ``min_words`` distinct words take no
part; a repeated id counts once; empty sides give an empty result; whole texts are read, whatever their length.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from ..plans.runtime import fresh_path, qualified, written
from .meetings import candidates
from .words import WordHashes, parity_sketch, words


@dataclass(frozen=True)
class Search:
    threshold: float = 0.8
    min_words: int = 8
    short: int = 4
    shard_words: int = 4_000_000
    hits: int = 250_000

    def zone(self, n: np.ndarray) -> np.ndarray:
        """For texts of n distinct words the places within which two neighbours of a similar text must stand."""
        out = np.zeros(len(n), np.int64)
        for a in range(int((1 - self.threshold) * n.max(initial=0) + 1e-9) + 1):  # words of its own
            d = np.floor((n - a) * (1 - self.threshold) / self.threshold + 1e-9).astype(np.int64)
            out = np.where(a <= d, np.maximum(out, d + 2 + a), out)
        return np.minimum(out, n)


# ---------------------------------------------------------------- records


def split_name(c: F.Column) -> F.Column:
    """train, val or test from values in any case and padding; ``validation`` is val; else null."""
    s = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(s == "validation", "val").when(s.isin("train", "val", "test"), s)


def _tokens(min_words: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for b in batches:
            at, texts, digests, folds, sizes, flat = [], [], [], [], [], []
            for k, text in enumerate(b["text"]):
                run = words(text)
                own = set(run)
                if len(own) >= min_words:
                    at.append(k)
                    texts.append(" ".join(run))
                    digests.append(xxhash.xxh3_128_digest(texts[-1]))
                    folds.append(xxhash.xxh3_64_digest("".join(run)))
                    sizes.append(len(own))
                    flat += [known[w] for w in own]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if sizes else np.empty(0, np.int64)
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            out = b[["id", "source", "split"]].iloc[at].reset_index(drop=True)
            yield out.assign(
                h=both[:, 0], g=both[:, 1], fold=np.frombuffer(b"".join(folds), np.int64),
                sketch=parity_sketch(np.array(flat, np.uint64), starts).view(np.int64), n=np.array(sizes, np.int32), words=texts,
            )

    return run


def tokenised(records: DataFrame, min_words: int) -> DataFrame:
    """(id, source, split, h, g, fold, sketch, n, words) of (id, source, split, text)."""
    kinds = "id string, source string, split string, h long, g long, fold long, sketch long, n int, words string"
    return records.mapInPandas(_tokens(min_words), kinds)


# ---------------------------------------------------------------- index


def _suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling until all ranks differ."""
    n, rank, k = len(symbols), symbols.astype(np.int64), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - k] = rank[k:] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        k *= 2


def _laid_out(owner: np.ndarray, symbols: np.ndarray, zone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, symbol) of what stands within the zones, for distinct symbols in order of text and symbol."""
    starts = np.searchsorted(owner, np.arange(len(zone)))
    keep = np.arange(len(owner)) - starts[owner] < zone[owner]
    return owner[keep], symbols[keep]


class Index:
    """Backward search over the texts of one shard: symbol 0 parts texts, the others are its words, rarest first."""

    def __init__(self, vocabulary: list[str], parts: dict[str, np.ndarray]) -> None:
        self.ids = {w: k + 1 for k, w in enumerate(vocabulary)}
        self.parts = parts
        self.suffixes, self.before, self.starts = parts["suffixes"], parts["before"], parts["starts"].astype(np.int64)
        self.n, self.size = len(self.suffixes), len(self.starts)
        counts = np.bincount(self.before, minlength=len(vocabulary) + 2)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        # ascending rows of each symbol in the transform; symbol * n + row makes one sorted array of them
        self.rows = np.repeat(np.arange(len(counts), dtype=np.int64), counts) * self.n + parts["rows"]
        self.text_of = (np.searchsorted(self.starts, np.arange(self.n), "right") - 1)[self.suffixes]
        self.words, self.bounds = parts["words"], parts["bounds"].astype(np.int64)
        self.sketch, self.sizes = parts["sketch"].view(np.uint64), parts["n"].astype(np.int64)
        self.fold_order = np.argsort(parts["fold"], kind="stable")
        self.folds = parts["fold"][self.fold_order]

    @classmethod
    def build(cls, texts: list[str], doc: dict[str, np.ndarray], search: Search = Search()) -> "Index":
        """From texts as words between blanks and (h, g, fold, sketch, n) of each."""
        found: dict[str, int] = {}
        runs = [t.split(" ") for t in texts]
        flat = np.fromiter((found.setdefault(w, len(found)) for run in runs for w in run), np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int64)
        owner = np.repeat(np.arange(len(runs)), np.diff(bounds))
        once = np.unique(owner * max(1, len(found)) + flat)
        own, word = once // max(1, len(found)), once % max(1, len(found))
        order = np.argsort(np.bincount(word, minlength=len(found)), kind="stable")
        symbol = np.empty(len(found), np.int64)
        symbol[order] = np.arange(1, len(found) + 1)
        names = list(found)
        own, sym = (lambda c: (c // (len(found) + 1), c % (len(found) + 1)))(np.sort(own * (len(found) + 1) + symbol[word]))
        own, sym = _laid_out(own, sym, search.zone(np.bincount(own, minlength=len(runs))))
        held = np.bincount(own, minlength=len(runs))
        starts = np.cumsum(held + 1) - held - 1
        laid = np.zeros(len(own) + len(runs), np.int32)
        laid[np.arange(len(own)) + own + 1] = sym
        suffixes = _suffix_array(laid)
        before = laid[suffixes - 1]  # row 0 of text 0 wraps to the last symbol, as the transform does
        parts = {"suffixes": suffixes.astype(np.uint32), "before": before, "rows": np.argsort(before, kind="stable").astype(np.uint32), "starts": starts.astype(np.uint32), "words": symbol[flat].astype(np.int32), "bounds": bounds}
        return cls([names[k] for k in order], parts | doc)

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.parts)
        words_ = json.dumps(list(self.ids)).encode()
        return zstandard.ZstdCompressor(level=1).compress(len(words_).to_bytes(8, "little") + words_ + out.getvalue())

    @classmethod
    def unpacked(cls, blob: bytes) -> "Index":
        raw = zstandard.ZstdDecompressor().decompress(blob)
        size = int.from_bytes(raw[:8], "little")
        with np.load(io.BytesIO(raw[8 + size :])) as parts:
            return cls(json.loads(raw[8 : 8 + size]), {k: parts[k] for k in parts.files})

    def extended(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the rows of symbol + what the rows low to high begin with."""
        base = symbols * self.n
        return np.searchsorted(self.rows, base + low), np.searchsorted(self.rows, base + high)

    def matches(self, owner: np.ndarray, symbols: np.ndarray, hits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, text) of the maximal matches of two words or more, about ``hits`` occurrences at a time.

        ``symbols`` are known words of each query in order; an occurrence that the word before extends belongs to a
        match that begins there.
        """
        end = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        pairs, which = np.unique(symbols[end - 1] * len(self.first) + symbols[end], return_inverse=True)
        left, right = pairs // len(self.first), pairs % len(self.first)
        low, high = self.extended(left, self.first[right], self.first[right + 1])
        low, count = low[which], (high - low)[which]
        some = count > 0
        end, low, count = end[some], low[some], count[some]
        prev = np.where((end >= 2) & (owner[end - 2] == owner[end]), symbols[end - 2], -1)
        who, total, begin = owner[end], np.cumsum(count), 0
        while begin < len(count):
            cut = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + hits, "right")))
            c = count[begin:cut]
            row = np.arange(int(c.sum())) + np.repeat(low[begin:cut] - np.cumsum(c) + c, c)
            fresh = self.before[row] != np.repeat(prev[begin:cut], c)
            yield np.repeat(who[begin:cut], c)[fresh], self.text_of[row[fresh]]
            begin = cut


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Of a qualified path; the scheme s3a is the same store as s3."""
    return pafs.FileSystem.from_uri(f"s3://{path[6:]}" if path.startswith("s3a://") else path)


def _build_shard(folder: str, search: Search):
    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["h", "g"]).reset_index(drop=True)
        index = Index.build(list(b["words"]), {k: b[k].to_numpy() for k in ("h", "g", "fold", "n", "sketch")}, search)
        fs, path = _filesystem(folder)
        fs.create_dir(path, recursive=True)
        final, partial = f"{path}/{int(b['shard'].iloc[0])}.idx", f"{path}/{int(b['shard'].iloc[0])}-{id(b)}.part"
        with fs.open_output_stream(partial) as out:
            out.write(index.packed())
        if fs.get_file_info(final).type == pafs.FileType.NotFound:
            fs.move(partial, final)
        else:  # the task ran before; its bytes are the same
            fs.delete_file(partial)
        return pd.DataFrame({"shard": [int(b["shard"].iloc[0])], "texts": [len(b)]})

    return run


def build_index(evaluation: DataFrame, search: Search) -> tuple[str, list[int]]:
    """(folder, shards) of the index over the distinct evaluation texts (h, g, fold, sketch, n, words)."""
    spark = evaluation.sparkSession
    folder = qualified(spark, fresh_path(spark, "index"))
    total = evaluation.agg(F.sum(F.size(F.split("words", " ")))).first()[0]
    if not total:
        return folder, []
    _filesystem(folder)  # a store that tasks can't open raises here
    shards = -(-int(total) // search.shard_words)
    dealt = evaluation.withColumn("shard", F.pmod("g", F.lit(shards)).cast("int"))
    built = dealt.groupBy("shard").applyInPandas(_build_shard(folder, search), "shard int, texts long").collect()  # one row per shard
    fs, path = _filesystem(folder)
    for r in built:
        if fs.get_file_info(f"{path}/{r['shard']}.idx").type == pafs.FileType.NotFound:
            raise FileNotFoundError(f"{folder}/{r['shard']}.idx: the folder of spark.checkpoint.dir is not shared by driver and executors")
    return folder, sorted(r["shard"] for r in built)


# ---------------------------------------------------------------- search


@lru_cache(maxsize=1)
def _read_shard(folder: str, shard: int) -> Index:
    fs, path = _filesystem(f"{folder}/{shard}.idx")
    with fs.open_input_stream(path) as f:  # a shard that is not there raises
        return Index.unpacked(f.read())


def _matched(mine: list[int], theirs: list[int], short: int) -> tuple[int, int]:
    """The words of ``mine`` within matches of ``short`` or more words with ``theirs``, and the stretches they form."""
    runs = set(zip(*(theirs[k:] for k in range(short))))
    covered = spans = till = 0
    for k, run in enumerate(zip(*(mine[j:] for j in range(short)))):
        if run in runs:
            spans += k > till or not covered
            covered += k + short - max(k, till)
            till = k + short
    return covered, spans


class Block:
    """Distinct training texts as codes into the block's own vocabulary."""

    def __init__(self, b: pd.DataFrame) -> None:
        self.h, self.g, self.fold = (b[c].to_numpy() for c in ("h", "g", "fold"))
        self.sketch, self.n = b["sketch"].to_numpy().view(np.uint64), b["n"].to_numpy().astype(np.int64)
        codes: dict[str, int] = {}
        runs = [w.split(" ") for w in b["words"]]
        self.codes = np.fromiter((codes.setdefault(w, len(codes)) for run in runs for w in run), np.int64)
        self.bounds = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int64)
        self.words = list(codes)
        once = np.unique(np.repeat(np.arange(len(runs)), np.diff(self.bounds)) * max(1, len(codes)) + self.codes)
        self.owner, self.once = once // max(1, len(codes)), once % max(1, len(codes))

    def known(self, index: Index) -> np.ndarray:
        """The symbol of each word of the vocabulary, -1 for words that the shard does not hold."""
        return np.fromiter((index.ids.get(w, -1) for w in self.words), np.int64, len(self.words))


def _judged(mine: list, theirs: list, n: int, m: int, same: bool, search: Search) -> tuple[int, int, float] | None:
    """(matched words, spans, similarity) of texts of n and m distinct words, if they are similar or their folded texts the same."""
    both = len(set(mine).intersection(theirs))
    similarity = both / (n + m - both)
    if similarity >= search.threshold - 1e-12 or same:
        return *((len(mine), 1) if same else _matched(mine, theirs, search.short)), similarity
    return None


def _match_block(index: Index, block: Block, search: Search) -> list[tuple]:
    known = block.known(index)
    sym = known[block.once]
    own, sym = block.owner[sym > 0], sym[sym > 0]
    code = np.sort(own * len(index.first) + sym)
    own, sym = code // len(index.first), code % len(index.first)
    unknown = block.n - np.bincount(own, minlength=len(block.n))  # these stand first in the order and match nothing
    own, sym = _laid_out(own, sym, search.zone(block.n) - unknown)

    slack = (1 - search.threshold) / (1 + search.threshold)  # sets of n and m words differ in (n + m) * slack at most
    own_slack, text_slack = (block.n * slack + 1e-3).astype(np.float32), (index.sizes * slack).astype(np.float32)
    low, high = np.searchsorted(index.folds, block.fold), np.searchsorted(index.folds, block.fold, "right")
    equal = np.repeat(np.arange(len(low)), high - low)
    spot = np.arange(len(equal)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
    pairs = [equal * index.size + index.fold_order[spot]]  # equal folded texts, whatever their words
    for q, text in index.matches(own, sym, search.hits):
        near = np.flatnonzero(np.bitwise_count(block.sketch[q] ^ index.sketch[text]) <= own_slack[q] + text_slack[text])
        q, text = q[near], text[near]
        n, m = block.n[q], index.sizes[text]
        near = np.minimum(n, m) >= search.threshold * np.maximum(n, m) - 1e-9
        pairs.append(np.unique(q[near] * index.size + text[near]))
    out: list[tuple] = []
    for code in np.unique(np.concatenate(pairs)).tolist():
        x, y = divmod(code, index.size)
        mine, theirs = known[block.codes[block.bounds[x] : block.bounds[x + 1]]].tolist(), index.words[index.bounds[y] : index.bounds[y + 1]].tolist()
        judged = _judged(mine, theirs, int(block.n[x]), int(index.sizes[y]), block.fold[x] == index.parts["fold"][y], search)
        if judged:
            out.append((int(block.h[x]), int(block.g[x]), int(index.parts["h"][y]), int(index.parts["g"][y]), *judged))
    return out


#: The table of bits that tells which texts are in a pair has 2 ** _BITS of them, in rows of 64, however many pairs there are.
_BITS = 27
_FOUND = "th long, tg long, h long, g long, matched_words int, spans int, similarity double"


def _stream(folder: str, shards: list[int], search: Search):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def blocks() -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            seen: set[int] = set()
            size = 0
            for b in batches:
                for k in range(0, len(b), 1000):  # texts may be long, so blocks end by their words
                    part = b.iloc[k : k + 1000].drop_duplicates(["h", "g"])
                    part = part[[h not in seen for h in part["h"]]]
                    seen.update(part["h"])
                    held.append(part)
                    size += int(part["words"].str.count(" ").sum()) + len(part)
                    if size >= search.shard_words:
                        yield pd.concat(held, ignore_index=True)
                        held, size = [], 0
                        seen = set()
            if size:
                yield pd.concat(held, ignore_index=True)

        for b in blocks():
            block = Block(b)
            for shard in shards:
                rows = _match_block(_read_shard(folder, shard), block, search)
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _FOUND.split(", ")]).astype({c: "int64" for c in ("th", "tg", "h", "g")})

    return run


def _verified(search: Search):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for th, tg, h, g, n, m, same, v, w in zip(*(b[c].tolist() for c in ("th", "tg", "h", "g", "n", "m", "same", "v", "w"))):
                judged = _judged(v.split(" "), w.split(" "), n, m, same, search)
                if judged:
                    rows.append((th, tg, h, g, *judged))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _FOUND.split(", ")]).astype({c: "int64" for c in ("th", "tg", "h", "g")})

    return run


def _by_words(evaluation: DataFrame, train: DataFrame, search: Search) -> DataFrame:
    """The matches of (h, g, fold, sketch, n, words), from the groups of their rarest words."""
    pairs = written(candidates(evaluation, train, search.threshold, search.min_words, max(1, search.shard_words // 8), search.hits), "candidates")
    spot = F.xxhash64("sketch").bitwiseAND(F.lit((1 << _BITS) - 1))
    bit = F.expr("shiftleft(1L, cast(xxhash64(sketch) & 63 as int))")

    def ends(texts: DataFrame, c: str) -> DataFrame:
        """The texts that may be in a pair, by a broadcast table of bits, so that no others move."""
        bits = pairs.select(F.col(c).alias("sketch")).groupBy(F.shiftright(spot, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
        some = texts.withColumn("word", F.shiftright(spot, 6)).join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(bit) != 0)
        return some.drop("word", "bits").dropDuplicates(["h", "g"])

    left = ends(train, "ts").select(F.col("sketch").alias("ts"), F.col("h").alias("th"), F.col("g").alias("tg"), F.col("fold").alias("a"), "n", F.col("words").alias("v"))
    right = ends(evaluation, "es").select(F.col("sketch").alias("es"), "h", "g", F.col("fold").alias("b"), F.col("n").alias("m"), F.col("words").alias("w"))
    both = pairs.join(left, "ts").join(right, "es").select("th", "tg", "h", "g", "n", "m", (F.col("a") == F.col("b")).alias("same"), "v", "w")
    return both.mapInPandas(_verified(search), _FOUND)


@dataclass
class Overlaps:
    records: DataFrame  #: (id, source, split, h, g) of all that take part; h and g name the class of equal texts
    matches: DataFrame  #: (th, tg, h, g, matched_words, spans, similarity), one row per training and evaluation class


def search(records: DataFrame, how: Search = Search()) -> Overlaps:
    """The overlapping classes of records (id, source, split, text) whose split is train, val or test."""
    rows = records.where("id is not null and text is not null and split in ('train', 'val', 'test')").dropDuplicates(["id"])
    kept = written(tokenised(rows, how.min_words), "tokens")
    kept.sparkSession.sparkContext._jvm.System.gc()  # else the shuffle files behind it stay until the driver happens to collect garbage
    held = kept.where("split <> 'train'")
    distinct = held.groupBy("h", "g", "fold").agg(*[F.first(c).alias(c) for c in ("sketch", "n", "words")])
    train = kept.where("split = 'train'").select("h", "g", "fold", "sketch", "n", "words")
    if (held.agg(F.sum(F.size(F.split("words", " ")))).first()[0] or 0) > how.shard_words:
        found = _by_words(written(distinct, "evaluation"), train, how)
    else:
        folder, shards = build_index(distinct, how)
        found = train.mapInPandas(_stream(folder, shards, how), _FOUND).dropDuplicates(["th", "tg", "h", "g"])  # a class may be in several blocks
    return Overlaps(kept.select("id", "source", "split", "h", "g"), written(found, "matches"))


def overlaps(records: DataFrame, how: Search = Search()) -> DataFrame:
    """(train_id, eval_id, train_source, eval_source, eval_split, matched_words, spans, similarity), one row per pair of records."""
    found = search(records, how)
    train = found.records.where("split = 'train'").select(F.col("h").alias("th"), F.col("g").alias("tg"), F.col("id").alias("train_id"), F.col("source").alias("train_source"))
    held = found.records.where("split <> 'train'").select("h", "g", F.col("id").alias("eval_id"), F.col("source").alias("eval_source"), F.col("split").alias("eval_split"))
    return found.matches.join(held, ["h", "g"]).join(train, ["th", "tg"]).select(
        "train_id", "eval_id", "train_source", "eval_source", "eval_split", "matched_words", "spans", "similarity")


def report(found: Overlaps) -> DataFrame:
    """(split, source, n_records, n_overlaps): evaluation records met again in train, and the pairs they are in.

    Pairs are counted by class: training copies x evaluation copies, without naming them.
    """
    copies = found.records.where("split = 'train'").groupBy(F.col("h").alias("th"), F.col("g").alias("tg")).agg(F.count("*").alias("copies"))
    met = found.matches.select("th", "tg", "h", "g").join(copies, ["th", "tg"]).groupBy("h", "g").agg(F.sum("copies").alias("met"))
    held = found.records.where("split <> 'train'").groupBy("h", "g", "split", "source").agg(F.count("*").alias("n"))
    return held.join(met, ["h", "g"]).groupBy("split", "source").agg(F.sum("n").alias("n_records"), F.sum(F.col("n") * F.col("met")).alias("n_overlaps"))
