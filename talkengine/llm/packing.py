"""Items of varying length into containers of fixed capacity: hierarchical multi-length packing.

Items are routed to context-size tiers: a tier per capacity, each holding the items that its capacity takes and the
next smaller one does not. Only an item over the largest capacity is cut, into full pieces and a rest. Each tier is
packed into windows of its own, best fit, longest item first; the gaps that remain in the windows of a longer tier are then filled from
the shorter tiers, again longest first, before these open windows of their own. With ``pack`` the windows of all tiers
have one capacity, with ``pack_tiers`` each tier has windows of its own size. The windows of a tier are dealt to step groups of
``group_windows`` so that the groups' attention costs (sum of squared piece lengths) balance.

Scale: items are dealt by hash to shards of about ``shard_tokens``; a shard is packed by one task from (id, tokens)
rows alone and leaves at most a few windows unfilled, so the loss is bounded by shards x capacity, about 0.1 %.
The number of shards follows the input; no shard depends on a key that could be hot.

Defined results: rows without id or size take no part, a size of 0 or less takes no room but gets a container, a
repeated id counts once (the larger size), an empty table gives an empty result, further columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

SHARD_TOKENS = 4_000_000
GROUP_WINDOWS = 8
_PIECES = "container_name string, capacity_tokens long, id long, piece int, start_token long, n_tokens long, container_id string, step_group string"


class Windows:
    """Open windows by the room left in them; the tightest that fits is found by bit operations."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.by_room, self.mask = capacity, {}, 0
        self.items: list[list[int]] = []

    def _put(self, window: int, room: int) -> None:
        self.by_room.setdefault(room, []).append(window)
        self.mask |= 1 << room

    def fit(self, size: int) -> int | None:
        """The window with the least room that takes ``size``, with its room already reduced; None if there is none."""
        above = self.mask >> size
        if not above:
            return None
        room = size + (above & -above).bit_length() - 1
        at = self.by_room[room]
        window = at.pop()
        if not at:
            self.mask &= ~(1 << room)
        self._put(window, room - size)
        return window

    def open(self, size: int) -> int:
        self.items.append([])
        self._put(len(self.items) - 1, self.capacity - size)
        return len(self.items) - 1


def cut(size: int, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(piece, start, length) of an item; one piece unless it exceeds the capacity."""
    size = max(size, 0)
    for piece, start in enumerate(range(0, max(size, 1), capacity)):
        yield piece, start, min(capacity, size - start)


def _route(sizes: list[int], capacities: list[int]) -> list[list[int]]:
    """Positions of the items by tier, each longest first (stable)."""
    tiers: list[list[int]] = [[] for _ in capacities]
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        tiers[next(t for t, c in enumerate(capacities) if sizes[k] <= c)].append(k)
    return tiers


def fill(sizes: list[int], tiers: list[int], windows: list[int]) -> list[tuple[int, list[list[int]]]]:
    """(tier, its windows as lists of item positions), longest tier first; the longest tier takes every item.

    Each tier packs its own items into windows of the size ``windows`` has for it; then their gaps take from the
    shorter tiers, and only what is left of those opens windows of their own.
    """
    routed, out = _route(sizes, tiers), []
    for t in range(len(tiers) - 1, -1, -1):
        own = Windows(windows[t])
        for k in routed[t]:
            window = own.fit(sizes[k])
            own.items[own.open(sizes[k]) if window is None else window].append(k)
        for below in range(t - 1, -1, -1) if own.items else ():
            rest = []
            for k in routed[below]:  # longest first
                window = own.fit(sizes[k])
                rest.append(k) if window is None else own.items[window].append(k)
            routed[below] = rest
        out.append((t, own.items))
    return out


def step_groups(costs: list[int], size: int) -> list[int]:
    """Windows dealt to groups of ``size``: costliest first, to and fro, so that group costs balance."""
    n = -(-len(costs) // size) if costs else 0
    out = [0] * len(costs)
    for rank, k in enumerate(sorted(range(len(costs)), key=lambda k: (-costs[k], k))):
        lap, place = divmod(rank, n)
        out[k] = place if lap % 2 == 0 else n - 1 - place
    return out


def _pack_shard(jobs: list[tuple[list[str], list[int], list[int]]], group_windows: int):
    """``jobs``: container name, longest item and window size of each tier, shortest tier first."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["n_tokens", "id"], ascending=[False, True])
        shard, rows = int(b["shard"].iloc[0]), []
        for names, tiers, sizes in jobs:
            pieces = [(i, *p) for i, n in zip(b["id"].tolist(), b["n_tokens"].tolist()) for p in cut(n, tiers[-1])]
            for t, windows in fill([p[3] for p in pieces], tiers, sizes):
                groups = step_groups([sum(pieces[k][3] ** 2 for k in w) for w in windows], group_windows)
                for w, (items, g) in enumerate(zip(windows, groups)):
                    where = f"{names[t]}-{shard}-{t}-{w}", f"{names[t]}-{shard}-{t}-{g}"
                    rows += [(names[t], sizes[t], *pieces[k], *where) for k in items]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _PIECES.split(", ")])

    return run


def _packed(sizes: DataFrame, jobs: list[tuple[list[str], list[int], list[int]]], shard_tokens: int, group_windows: int) -> DataFrame:
    items = sizes.select("id", F.col("n_tokens").cast("long").alias("n_tokens")).where("id is not null and n_tokens is not null").groupBy("id").agg(F.max("n_tokens").alias("n_tokens"))
    weight = items.agg(F.sum(F.greatest("n_tokens", F.lit(0)) + 64)).first()[0]  # empty items count, as they are rows too
    shards = max(1, -(-int(weight or 0) // shard_tokens))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(_pack_shard(jobs, group_windows), _PIECES)


def pack(sizes: DataFrame, capacities: dict[str, int], shard_tokens: int = SHARD_TOKENS, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """For every container name a packing of all items (id, n_tokens) into windows of its capacity; the capacities up
    to it are the tiers."""
    ascending, jobs = sorted(set(capacities.values())), []
    for name, capacity in sorted(capacities.items()):
        tiers = [c for c in ascending if c <= capacity]
        jobs.append(([name] * len(tiers), tiers, [capacity] * len(tiers)))
    return _packed(sizes, jobs, shard_tokens, group_windows)


def pack_tiers(sizes: DataFrame, capacities: dict[str, int], shard_tokens: int = SHARD_TOKENS, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """One packing of all items, each in a window of its own tier or in a gap of a longer one."""
    names = {capacity: name for name, capacity in sorted(capacities.items(), reverse=True)}
    tiers = sorted(names)
    return _packed(sizes, [([names[c] for c in tiers], tiers, tiers)], shard_tokens, group_windows)


def fills(packed: DataFrame) -> DataFrame:
    """(container_name, capacity_tokens, container_id, step_group, n_pieces, used_tokens, fill) per container."""
    by = packed.groupBy("container_name", "capacity_tokens", "container_id", "step_group").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("used_tokens"))
    return by.withColumn("fill", F.round(F.col("used_tokens") / F.col("capacity_tokens"), 6))
