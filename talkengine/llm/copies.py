"""Duplicates hidden by formatting: recursive radix partitioning on canonical bytes, then tries that count.

The canonical bytes of a record are its folded text, or, where the text consists of two or more labelled fields
(``label: value`` segments parted by ``|`` or ``;``), its folded fields in sorted order, so that field order does
not matter. Records are dealt to buckets by the first bytes of that string; buckets over ``capacity`` are split by
further bytes until each fits or holds one string only. Each task then counts its buckets one at a time in a trie
whose terminals hold the number of records and the smallest id.

Skew: equal strings are summed batch by batch before the shuffle, so a text that makes up a third of all rows
reaches its trie as one partial count per batch, not as rows.

Defined results: rows without id or without text (null) take no part; texts that are empty when folded are copies
of one another; a repeated (group, id) row counts once; an empty table gives an empty result. Only the named
columns are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans.runtime import written
from .words import _GAP, normal

CAPACITY = 200_000
#: Prefixes of buckets to split are broadcast up to this many, beyond it joined by shuffle.
BROADCAST_PREFIXES = 1_000_000
_SEPARATOR = re.compile(r"[|;]")
_CHUNK = 8


def fields(text: str) -> list[str] | None:
    """The folded fields of a normalised text made of labelled fields only, else None."""
    for separator in (_SEPARATOR, re.compile(r"\|"), re.compile(";")):
        parts = [p for p in separator.split(text) if _GAP.sub("", p)]
        if len(parts) < 2:
            continue
        heads = [p.partition(":") for p in parts]
        if all(colon and _GAP.sub("", label) and len(label.split()) <= 4 for label, colon, _ in heads):
            return [_GAP.sub("", p) for p in parts]
    return None


def canonical(text: str) -> bytes:
    """The bytes that two records share exactly if they are copies."""
    text = normal(text)
    if ":" in text and ("|" in text or ";" in text) and (parts := fields(text)):
        return b"\x02" + b"\x01".join(sorted(p.encode() for p in parts))
    return b"\x03" + _GAP.sub("", text).encode("utf-8", "surrogatepass")


def _canonical_rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"grp": b["grp"], "id": b["id"], "canon": [canonical(t) for t in b["text"]]})


def canonical_records(df: DataFrame, id_col: str, text_col: str, group: str | F.Column = "") -> DataFrame:
    """(grp, id, canon), one row per record; ``group`` keeps tables apart."""
    grp = F.lit(group) if isinstance(group, str) else group
    rows = df.select(grp.alias("grp"), F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    return rows.mapInPandas(_canonical_rows, "grp string, id string, canon binary").dropDuplicates(["grp", "id"])


def longer(length: int) -> int:
    """How many bytes a bucket's prefix has one level further down: 0, 4, 8, 16, ..."""
    return 2 * length or 4


def oversized_prefixes(records: DataFrame, capacity: int = CAPACITY) -> set[tuple[str, int, bytes]]:
    """(group, length, prefix) of the buckets that must be split further. At most rows / capacity of them per level, so they fit the driver.

    A bucket of one string can't be split by any byte and needs none: its counts are summed before they move.
    """
    found: set[tuple[str, int, bytes]] = set()
    rest, length = records, 0
    while True:
        prefix = F.substring("canon", 1, length) if length else F.lit(b"")
        over = (
            rest.groupBy("grp", prefix.alias("prefix")).agg(F.count("*").alias("n"), F.min("canon").alias("low"), F.max("canon").alias("high"))
            .where((F.col("n") > capacity) & (F.col("low") != F.col("high"))).select("grp", "prefix")
        )
        level = [(r["grp"], bytes(r["prefix"])) for r in over.collect()]
        if not level:
            return found
        found |= {(g, length, p) for g, p in level}
        keep = records.sparkSession.createDataFrame([(g, bytearray(p)) for g, p in level], "grp string, prefix binary")
        keep = F.broadcast(keep) if len(level) <= BROADCAST_PREFIXES else keep
        rest = records.withColumn("prefix", prefix).join(keep, ["grp", "prefix"], "left_semi").select("grp", "canon")
        length = longer(length)


class Trie:
    """A trie over byte strings in steps of a few bytes; terminals hold a count and the smallest id."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: bytes, n: int, least: str) -> None:
        node = self.root
        for k in range(0, len(key), _CHUNK):
            part = key[k : k + _CHUNK]
            node = node.get(part) or node.setdefault(part, {})
        end = node.get(None)
        node[None] = (n, least) if end is None else (end[0] + n, min(end[1], least))

    def terminals(self) -> Iterator[tuple[bytes, int, str]]:
        stack = [(b"", self.root)]
        while stack:
            path, node = stack.pop()
            for part, below in node.items():
                if part is None:
                    yield path, *below
                else:
                    stack.append((path + part, below))


def _partial_counts(split: set[tuple[str, int, bytes]]):
    def partial(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums = b.groupby(["grp", "canon"], sort=False)["id"].agg(["size", "min"]).reset_index()
            buckets = []
            for g, c in zip(sums["grp"], sums["canon"]):
                length = 0
                while (g, length, c[:length]) in split:
                    length = longer(length)
                buckets.append(c[:length])
            yield pd.DataFrame({"grp": sums["grp"], "bucket": buckets, "canon": sums["canon"], "n": sums["size"], "least": sums["min"]})

    return partial


def _trie_counts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, trie = None, Trie()

    def emit() -> pd.DataFrame:
        rows = [(now[0], *t) for t in trie.terminals()]
        return pd.DataFrame(rows, columns=["grp", "canon", "n_copies", "kept_id"])

    for b in batches:
        for g, bucket, canon, n, least in zip(b["grp"], b["bucket"], b["canon"], b["n"], b["least"]):
            if (g, bucket) != now:
                if now is not None:
                    yield emit()
                now, trie = (g, bucket), Trie()
            trie.add(canon, int(n), least)
    if now is not None:
        yield emit()


def counted(records: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(grp, canon, n_copies, kept_id): one row per distinct record with its number of copies."""
    split = oversized_prefixes(records, capacity)
    parts = records.mapInPandas(_partial_counts(split), "grp string, bucket binary, canon binary, n long, least string")
    ordered = parts.repartition("grp", "bucket").sortWithinPartitions("grp", "bucket")  # a group that fits is one bucket
    return ordered.mapInPandas(_trie_counts, "grp string, canon binary, n_copies long, kept_id string")


def copies(records: DataFrame, counts: DataFrame) -> DataFrame:
    """(kept_id, copy_id): every record but the one kept, of the records that have copies."""
    groups = counts.where("n_copies > 1").select("grp", "canon", "kept_id")
    return records.join(groups, ["grp", "canon"]).where("id <> kept_id").select("kept_id", F.col("id").alias("copy_id"))


def find_copies(records: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    records = written(records, "canonical")
    return copies(records, counted(records, capacity))
