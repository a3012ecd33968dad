"""Minimax contiguous shards of ordered atomic groups."""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.common import prefix_sums, settle


class Cuts:
    """Known cut positions (ends of groups, in bytes) and which gaps between them may hide more."""

    def __init__(self, total: int):
        self.at, self.open = [0, total], [True]  # open[i]: unknown cuts may lie between at[i] and at[i + 1]

    def sure(self, x: int) -> int:
        """Largest known cut <= x."""
        return self.at[bisect.bisect_right(self.at, x) - 1]

    def hope(self, x: int) -> int:
        """Upper bound of the largest cut <= x."""
        i = bisect.bisect_right(self.at, x) - 1
        return x if i < len(self.open) and self.open[i] else self.at[i]

    def walk(self, capacity: int, shards: int, step) -> list[int]:
        """Greedy ends of the shards at this capacity; the last is the total if it is feasible."""
        ends, x = [], 0
        for _ in range(shards):
            x = step(min(x + capacity, self.at[-1]))
            ends.append(x)
        return ends

    def least(self, shards: int, low: int, step) -> int:
        """Smallest feasible capacity under ``step``, by binary search with the greedy check."""
        high = max(low, self.at[-1])
        while low < high:
            mid = (low + high) // 2
            if self.walk(mid, shards, step)[-1] >= self.at[-1]:
                high = mid
            else:
                low = mid + 1
        return low

    def refine(self, cells: list[tuple[int, int, int]], a: int, b: int) -> None:
        """Take in (first cut, last cut, number of cuts) of each cell of the open gap from ``a`` to ``b``."""
        i = bisect.bisect_left(self.at, a)
        at, hidden = [a], []
        for first, last, n in sorted(cells):
            if first > at[-1]:
                at.append(first)
                hidden.append(False)
            if last > at[-1]:
                at.append(last)
                hidden.append(n > 2)
        self.at[i : i + 2] = at
        self.open[i : i + 1] = hidden


def minimax_cuts(groups: DataFrame, size: str, before: str, shards: int, cells: int = 8192) -> tuple[int, list[int]]:
    """(capacity, ends of the shards) for ordered atomic groups with exclusive prefix sums in ``before``.

    The smallest capacity is found by binary search with a greedy check. The
    driver never holds the groups: it asks Spark for group ends in each of
    ``cells`` ranges of the prefix sums, brackets the answer between what
    known ends reach and what ends hidden in a range could reach at best, and
    refines only the ranges where a shard could end, until the two agree. Each
    answer names the first and last end of a range, so ranges shrink each time.
    """
    top = groups.agg(F.sum(size), F.max(size)).first()
    if top[0] is None:
        return 0, [0] * shards
    total, largest = int(top[0]), int(top[1])
    cuts = Cuts(total)
    gaps = [(0, total)]
    ends = (F.col(before) + F.col(size)).alias("end")
    while True:
        width = sum(b - a for a, b in gaps)
        asked = [0]
        for a, b in gaps:
            m = max(2, cells * (b - a) // width)
            asked += np.unique(np.linspace(a, b, min(b - a, m) + 1).astype(np.int64)).tolist()
        asked = sorted(set(asked))
        bounds = np.array(asked)

        def ask(batches, bounds=bounds):
            import pandas as pd

            for pdf in batches:
                e = pdf["end"].to_numpy(np.int64)
                i = np.searchsorted(bounds, e, side="left") - 1  # cell i holds ends in (bounds[i], bounds[i + 1]]
                ok = (i >= 0) & (i < len(bounds) - 1)
                yield pd.DataFrame({"i": i[ok], "end": e[ok]}).groupby("i")["end"].agg(["min", "max", "count"]).reset_index()

        told = groups.select(ends).mapInPandas(ask, "i long, `min` long, `max` long, `count` long")
        got = {r[0]: r[1:] for r in told.groupBy("i").agg(F.min("min"), F.max("max"), F.sum("count")).collect()}
        for a, b in gaps:
            own = range(bisect.bisect_left(asked, a), bisect.bisect_left(asked, b))
            cuts.refine([got[i] for i in own if i in got], a, b)
        sure = cuts.least(shards, largest, cuts.sure)
        hope = cuts.least(shards, largest, cuts.hope)
        if sure == hope:
            return sure, cuts.walk(sure, shards, cuts.sure)
        spans = list(zip(cuts.walk(hope, shards, cuts.sure), cuts.walk(sure, shards, cuts.hope), strict=True))
        gaps = [(a, b) for i, (a, b) in enumerate(zip(cuts.at, cuts.at[1:], strict=False)) if cuts.open[i] and any(a <= y and b >= x for x, y in spans)]


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``docs`` in contiguous shards of near equal bytes; equal texts stay together.

    Groups of equal texts, ordered by their smallest doc_id, are atomic; the
    shard capacity is the smallest for which ``shards`` contiguous runs hold
    all groups. Size: UTF-8 bytes plus 1; a null text counts as the empty one.
    ``slot`` numbers a shard's rows in that order; null doc_ids come first,
    repeated rows get slots of their own. No rows give no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id", F.sha2(text, 256).alias("_group"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = settle(rows)
    groups = rows.groupBy("_group").agg(F.min("doc_id").alias("_first"), F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    placed = settle(prefix_sums(groups, ["_first", "_group"], {"_before": "_bytes", "_row": "_rows"}))
    _, ends = minimax_cuts(placed, "_bytes", "_before", shards)
    shard = sum((F.col("_before") >= F.lit(e)).cast("int") for e in ends[:-1]) if shards > 1 else F.lit(0)
    placed = placed.withColumn("shard", F.least(shard, F.lit(shards - 1)).cast("int"))
    first_row = placed.groupBy("shard").agg(F.min("_row").alias("_start"))
    placed = placed.join(F.broadcast(first_row), "shard").select("_group", "_first", "shard", (F.col("_row") - F.col("_start")).alias("_slot"), "_rows")
    # Copies of one text are numbered in a range-dealt order, so a group of any size is split over tasks.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(32))
    in_group = rows.withColumn("_salt", salt)
    keys = in_group.select("_group", "_salt").distinct()
    wide = keys.join(placed, "_group")
    joined = in_group.join(wide, ["_group", "_salt"])
    alone = joined.filter("_rows = 1").select("doc_id", "size", "text_crc32", "shard", F.col("_slot").alias("slot"))
    copies = prefix_sums(joined.filter("_rows > 1").select("_group", "_first", "doc_id", "size", "text_crc32", "shard", "_slot", F.lit(1).cast("long").alias("_one")), ["_group", "doc_id"], {"_n": "_one"})
    copies = settle(copies)
    begin = copies.groupBy("_group").agg(F.min("_n").alias("_n0"))
    split = copies.withColumn("_salt", salt)
    begin = split.select("_group", "_salt").distinct().join(begin, "_group")
    copies = split.join(begin, ["_group", "_salt"]).select("doc_id", "size", "text_crc32", "shard", (F.col("_slot") + F.col("_n") - F.col("_n0")).alias("slot"))
    return alone.unionByName(copies).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
