"""Best-fit packing whose bin counts are certified by dual-feasible-function bounds."""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.common import encode_texts, settle

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocab: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Documents as token pieces of at most ``capacity`` ids; one pass, no shuffle.

    Ids are those of the tokenizers library, ``end_id`` ends each document. A
    longer document is cut into full pieces, behind a first one that takes the
    remainder. A null text is empty and gives one piece with the end id alone;
    repeated rows give repeated pieces; a null doc_id stays null.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            ids_of = encode_texts(pdf["text"], vocab)
            for doc, ids in zip(pdf["doc_id"], ids_of, strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                n = len(ids)
                at, k = 0, 0
                while at < n:
                    size = (n % capacity or capacity) if at == 0 else capacity
                    rows.append((None if pd.isna(doc) else int(doc), k, at, size, zlib.crc32(ids[at : at + size].tobytes())))
                    at, k = at + size, k + 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(run, PIECES)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each size, and the number of bins. A bit mask of the free room in use finds the tightest bin."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        fit = rooms >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                rooms &= ~(1 << room)
        else:
            room, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - room
        if room > s:
            free[room - s].append(b)
            rooms |= 1 << (room - s)
    return bins, offsets, used


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by two families of dual feasible functions.

    The threshold functions count items over capacity - a once each, drop those
    under a, and spread the rest; the rounding functions replace x by
    floor((k + 1) x) / k. Both map sizes so that no full bin sums to over 1, so
    the sum of the images bounds the number of bins. All arithmetic is exact.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    mass = count * np.arange(capacity + 1)
    n_cum, m_cum = np.cumsum(count), np.cumsum(mass)
    half = capacity // 2
    best = -(-int(m_cum[-1]) // capacity)
    for a in np.flatnonzero(count[: half + 1]).tolist():
        large = int(n_cum[-1] - n_cum[capacity - a])
        middle, middle_mass = int(n_cum[capacity - a] - n_cum[half]), int(m_cum[capacity - a] - m_cum[half])
        small_mass = int(m_cum[half] - (m_cum[a - 1] if a else 0))
        best = max(best, large + middle + max(0, -(-(small_mass - (middle * capacity - middle_mass)) // capacity)))
    x = np.arange(capacity + 1, dtype=np.int64)
    for k in range(1, 33):
        exact = (k + 1) * x % capacity == 0
        image = np.where(exact, x * k, (k + 1) * x // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((count * image).sum()) // (k * capacity)))
    return best


def pack(pieces: DataFrame, capacity: int = 2048, per_part: int = 20_000, rounds: int = 3) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``, plus ``certified``.

    Pieces are dealt evenly by a hash into parts of about ``per_part`` and each
    part is packed best fit decreasing. A part whose bins equal its lower bound
    is proven best and stays, but for its emptiest bin: one bin a part is what
    rounding up costs. The others keep their full bins alone. The pieces of all
    other bins form a common pool, which is dealt anew and packed again; a deal
    that needs no fewer bins is not taken and ends the search.
    ``certified``: the part's number of bins equals its bound. Each round is
    one shuffle of narrow rows; the pool shrinks from round to round. Pieces of
    equal size are ordered by (doc_id, piece), so results are repeatable.
    """
    out_schema = pieces.schema
    for name, kind in (("sequence_id", "long"), ("offset", "long"), ("certified", "boolean"), ("_open", "boolean")):
        out_schema = out_schema.add(name, kind)

    def deal(df: DataFrame, n: int, k: int) -> DataFrame:
        parts = max(1, math.ceil(n / per_part))
        part = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "piece", "ids_crc32", F.lit(k)), F.lit(parts)).cast("long")

        def run(key, pdf):
            pdf = pdf.sort_values(["doc_id", "piece"], kind="stable")
            sizes = pdf["length"].to_numpy(np.int64)
            bins, offsets, used = best_fit_decreasing(sizes, capacity)
            gap = used - lower_bound(sizes, capacity)
            fill = np.bincount(bins, weights=sizes, minlength=used)
            out = pdf.drop(columns=["_part"])
            # 8 bits of round, 28 of part, 27 of bin: unique over all rounds
            out["sequence_id"] = (k << 55) | (int(key[0]) << 27) | bins
            out["offset"], out["certified"] = offsets, gap == 0
            out["_open"] = (fill[bins] < capacity) & ((gap > 0) | (bins == fill.argmin()))
            return out

        return settle(df.withColumn("_part", part).groupBy("_part").applyInPandas(run, out_schema))

    def sequences(df: DataFrame) -> int:
        return df.select("sequence_id").distinct().count()

    packed = deal(pieces, pieces.count(), 0)
    done, pool = [], packed
    for k in range(1, rounds + 1):
        free = pool.filter("_open")
        n = free.count()
        if not n:
            break
        again = deal(free.select(*pieces.columns), n, k)
        if sequences(again) >= sequences(free):
            break
        done.append(pool.filter("not _open"))
        pool = again
    for d in reversed(done):
        pool = d.unionByName(pool)
    return pool.drop("_open")


def pack_documents(docs: DataFrame, vocab: str, capacity: int = 2048, per_part: int = 20_000, rounds: int = 3) -> DataFrame:
    """``docs`` (doc_id, text) packed: one row a piece, see `token_pieces` and `pack`.

    A null text is the empty one and has its end id alone; repeated rows are documents of their own; an empty table gives
    no rows. A very long text is encoded at once by one task, which then holds its ids (four bytes each) besides the text,
    and cut into pieces; long runs of blanks in it do not matter.
    """
    return pack(settle(token_pieces(docs, vocab, capacity)), capacity, per_part, rounds)
