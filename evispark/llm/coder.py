"""Token ids in coded blocks: a context-mixing model of orders 0 to 2 drives a range coder.

Blocks come in groups. The counts of a group give one model, stored ahead of its first block. Many blocks are coded in
step, one lane of an array each, so that the work of one step is a few array operations whatever the number of lanes.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.llm.common import crc32_join, encode_texts, scratch_path, settle

LIST = 4  # ids a context lists; the places of their shares fill a number of 64 bits
LIST_BITS, ID_BITS = 14, 20  # a list's shares, and those of order 0, are out of two to this power
SLOTS = 1 << 16  # for contexts of order 2
SEEN = 3  # times an id has to follow a context to be listed
PAYS = 0.05  # bits that a list has to save each time its context is met
# The coder's window has 53 bits, which a double holds exactly, and moves on by 32.
WINDOW, KEPT = 53, 21
LOW = 1 << KEPT
EACH, TOPS = np.uint64(0x0001000100010001), np.uint64(0x8000800080008000)
PARTS = (("ids", "<u2"), ("widths", "<u4"), ("one", "<u2"), ("two", "<u4"), ("listed", "<u2"), ("shares", "<u2"))


def runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    return starts, np.diff(starts, append=len(a))


def contexts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id before each id of the rows, and the one before that; 0 ahead of a row."""
    c1, c2 = np.zeros_like(x), np.zeros_like(x)
    c1[:, 1:], c2[:, 2:] = x[:, :-1], x[:, :-2]
    return c1, c2


def slot(c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
    return (c1 * 40503 ^ c2) & (SLOTS - 1)


class Model:
    """Shares of ids behind their contexts, from the counts of a group of blocks.

    A context of order 2, or else of order 1, may list the ids that follow it
    most often. An id's share there mixes its counts behind the context with
    what the next lower order says, down to order 0; the share that is left
    goes to order 0, which knows every id of the group. Contexts whose lists
    do not pay for themselves have none.
    """

    def __init__(self, data: bytes):
        raw, at, parts = zlib.decompress(data), 4 * len(PARTS), {}
        for size, (name, kind) in zip(struct.unpack_from(f"<{len(PARTS)}I", raw), PARTS, strict=True):
            parts[name] = np.frombuffer(raw, kind, size, at)
            at += parts[name].nbytes
        ids, widths = parts["ids"], parts["widths"].astype(np.int64)
        self.width = np.zeros(1 << 16, np.int64)
        self.width[ids] = widths
        self.start = np.cumsum(self.width) - self.width
        self.by_share = np.repeat(ids, widths)
        one, two = parts["one"], parts["two"]
        # list 0 is empty: all goes to order 0
        shares = np.zeros((len(one) + len(two) + 1, LIST), np.int16)
        shares[1:] = parts["shares"].reshape(-1, LIST)
        listed = np.full((len(shares), LIST + 1), -1, np.int32)
        listed[1:, :LIST] = parts["listed"].reshape(-1, LIST)
        listed[:, :LIST][shares == 0] = -1
        cum = np.zeros((len(shares), LIST + 2), np.int16)
        np.cumsum(shares, axis=1, out=cum[:, 1:-1])
        cum[:, -1] = 1 << LIST_BITS
        self.lists = len(shares) - 1
        # per list and rank the id, where its share begins, and its share: one number each
        self.entry = (listed.astype(np.int64) << 32 | cum[:, :-1].astype(np.int64) << 16 | np.diff(cum, axis=1)).ravel()
        # per list the LIST places where shares end, in 16 bits each
        self.ends = np.ascontiguousarray(cum[:, 1:-1]).view(np.uint64).ravel()
        self.by_rank = [listed[:, k].astype(np.int64) for k in range(LIST)]
        self.one = np.zeros(1 << 16, np.int64)
        self.one[one] = np.arange(1, len(one) + 1)
        self.key, self.two = np.full(SLOTS, -1), np.zeros(SLOTS, np.int64)
        at = slot((two & 0xFFFF).astype(np.int64), (two >> 16).astype(np.int64))
        self.key[at], self.two[at] = two, np.arange(len(one) + 1, len(shares))
        self.any_two = len(two) > 0

    def list_of(self, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
        """Number of the list that holds behind the ids ``c1``, ahead of which stand ``c2`` (both of 64 bits)."""
        out = self.one[c1]
        if self.any_two:
            at = slot(c1, c2)
            out = np.where(self.key[at] == (c2 << 16 | c1), self.two[at], out)
        return out

    def rank_at(self, lists: np.ndarray, v: np.ndarray) -> np.ndarray:
        """How many shares of the lists end at ``v`` or before it: all four are compared at once."""
        return np.bitwise_count((v.view(np.uint64) * EACH | TOPS) - self.ends[lists] & TOPS)

    def rank(self, lists: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Place of ``x`` in the lists; LIST where it is not in its list."""
        out = np.full(x.shape, LIST, np.int8)
        for k, ids in enumerate(self.by_rank):
            out -= (ids[lists] == x) * np.int8(LIST - k)
        return out


def pack(parts: dict[str, np.ndarray]) -> bytes:
    arrays = [parts[name].astype(kind).ravel() for name, kind in PARTS]
    return zlib.compress(struct.pack(f"<{len(PARTS)}I", *map(len, arrays)) + b"".join(a.tobytes() for a in arrays), 1)


def fit(x: np.ndarray) -> bytes:
    """A `Model` of the rows of ``x`` (uint16), as bytes."""
    counts = np.bincount(x.ravel(), minlength=1 << 16)
    ids = np.flatnonzero(counts)
    widths = 1 + counts[ids] * ((1 << ID_BITS) - len(ids)) // x.size
    widths[widths.argmax()] += (1 << ID_BITS) - widths.sum()
    share = np.zeros(1 << 16)
    share[ids] = widths / (1 << ID_BITS)
    bits = -np.log2(share, where=share > 0, out=np.zeros(1 << 16))
    none = np.zeros(0, np.int64)
    parts = {"ids": ids, "widths": widths, "one": none, "two": none, "listed": none, "shares": none}

    def lists(keys, lower, known, unknown):
        """Contexts, listed ids, shares and savings of the lists that pay, from sorted keys of context and id.

        ``lower`` has the share of a context's id by the order below, ``known`` the bits it takes without the list, and
        ``unknown`` the bits a context's other ids take there more than in order 0.
        """
        first, n = runs(keys)
        keys = keys[first]
        begin, sizes = runs(keys >> keys.dtype.type(16))
        total = np.add.reduceat(n, begin)
        of = np.repeat(np.arange(len(begin)), sizes)
        often = np.flatnonzero(n >= SEEN)
        often = often[np.lexsort((-n[often], of[often]))]
        if not len(often):
            return none, none, none, none
        at, size = runs(of[often])
        rank = np.arange(len(often)) - np.repeat(at, size)
        often, rank = often[rank < LIST], rank[rank < LIST]
        used, row = np.unique(of[often], return_inverse=True)
        n, total, keys, context = n[often], total[used], keys[often].astype(np.int64), (keys[begin[used]] >> keys.dtype.type(16)).astype(np.int64)
        mixed = (n + lower(keys)) / (total[row] + 1)
        q = np.maximum(1, (mixed * ((1 << LIST_BITS) - LIST - 1)).astype(np.int64))
        listed, shares = np.zeros((len(used), LIST), np.int64), np.zeros((len(used), LIST), np.int64)
        listed[row, rank], shares[row, rank] = keys & 0xFFFF, q
        saved = np.bincount(row, n * (np.log2(q) - LIST_BITS + known(keys)), len(used))
        others = total - np.bincount(row, n, len(used))
        saved += others * (np.log2((1 << LIST_BITS) - shares.sum(1)) - LIST_BITS + unknown(context))
        saved -= 8 * (4 + 4 * (shares > 0).sum(1))
        pays = saved > PAYS * total
        return context[pays], listed[pays], shares[pays], saved[pays]

    c1, c2 = contexts(x)
    key = c1.astype(np.uint32)
    key <<= 16
    key |= x
    pairs = np.sort(key, axis=None)
    one, listed, shares, _ = lists(pairs, lambda k: share[k & 0xFFFF], lambda k: bits[k & 0xFFFF], lambda c: np.zeros(len(c)))
    parts |= {"one": one, "listed": listed, "shares": shares}
    first, n = runs(pairs)
    pairs = pairs[first]
    # how often each id stands ahead of another; 0 stands ahead of each row too
    after = counts - np.bincount(x[:, -1], minlength=1 << 16)
    after[0] += len(x)
    model = Model(pack(parts))
    left = np.zeros(1 << 16)
    if len(one):
        left[one] = LIST_BITS - np.log2((1 << LIST_BITS) - shares.sum(1))

    def lower(k):
        pair = (k & 0xFFFFFFFF).astype(np.uint32)
        return (n[np.searchsorted(pairs, pair)] + share[k & 0xFFFF]) / (after[k >> 16 & 0xFFFF] + 1)

    def known(k):
        c, y = k >> 16 & 0xFFFF, k & 0xFFFF
        number = model.one[c]
        rank = model.rank(number, y)
        width = model.entry[number * (LIST + 1) + rank] & 0xFFFF
        return np.where(rank < LIST, LIST_BITS - np.log2(width), left[c] + bits[y])

    triples = c2.astype(np.uint64).ravel()
    triples <<= 32
    triples |= key.ravel()
    del c1, c2, key
    triples.sort()
    two, listed2, shares2, saved = lists(triples, lower, known, lambda c: left[c & 0xFFFF])
    if len(two):
        # of contexts that meet in a slot, the one that saves most
        order = np.argsort(-saved, kind="stable")
        _, best = np.unique(slot(two & 0xFFFF, two >> 16)[order], return_index=True)
        keep = order[best]
        parts |= {"two": two[keep], "listed": np.concatenate([listed.reshape(-1, LIST), listed2[keep]]), "shares": np.concatenate([shares.reshape(-1, LIST), shares2[keep]])}
    return pack(parts)


def encode_lanes(ids: np.ndarray, columns: int = 64) -> list[bytes]:
    """Payloads of the rows of ``ids`` (uint16 range), a group; the first begins with the model of all."""
    x = ids.astype(np.uint16)
    lanes, n = x.shape
    data = fit(x)
    model = Model(data)
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, (1 << WINDOW) - 1, np.int64)
    room = 2 * n + 2
    words, used = np.zeros(lanes * room, np.int64), np.arange(lanes, dtype=np.int64) * room

    def move():
        m = (rng < LOW).nonzero()[0]
        if len(m):
            lo, at = low[m], used[m]
            words[at] = lo >> KEPT
            used[m] = at + 1
            low[m] = (lo & (LOW - 1)) << 32
            rng[m] <<= 32

    steps = np.zeros((n + 2, lanes), np.uint16)  # behind the two ids ahead of all rows
    steps[2:] = x.T
    for begin in range(0, n, columns):
        after = steps[begin : begin + columns + 2].astype(np.int64)
        here, c1, c2 = after[2:], after[1:-1], after[:-2]
        if model.lists:
            lists = model.list_of(c1, c2)
            rank = model.rank(lists, here)
            entry = model.entry[lists * (LIST + 1) + rank]
            share, part, other = entry >> 16 & 0xFFFF, entry & 0xFFFF, rank == LIST
            here = here[other]
            start, width, e = model.start[here], model.width[here], 0
            for j, missed in enumerate(other):
                r = rng >> LIST_BITS
                low += r * share[j]
                np.multiply(r, part[j], out=rng)
                move()
                m = missed.nonzero()[0]
                b, e = e, e + len(m)
                r = rng[m] >> ID_BITS
                low[m] += r * start[b:e]
                rng[m] = r * width[b:e]
                move()
        else:
            for start, width in zip(model.start[here], model.width[here], strict=True):
                r = rng >> ID_BITS
                low += r * start
                np.multiply(r, width, out=rng)
                move()
    # a value of the last interval that needs one word more
    words[used] = low + LOW - 1 >> KEPT
    sizes = used % room + 1
    words = words.reshape(lanes, room)[:, : sizes.max()]
    while (carry := words >> 32).any():
        words = words & 0xFFFFFFFF
        words[:, :-1] += carry[:, 1:]
    # the reader's window begins with the first KEPT bits
    out = np.zeros((lanes, words.shape[1] + 1), "<u4")
    out[:, :-1] = words >> 32 - KEPT
    out[:, 1:] |= ((words & (1 << 32 - KEPT) - 1) << KEPT).astype(np.uint32)
    payloads = [row[: size + 1].tobytes() for row, size in zip(out, sizes, strict=True)]
    payloads[0] = struct.pack("<I", len(data)) + data + payloads[0]
    return payloads


def decode_lanes(payloads: list[bytes], n: int) -> np.ndarray:
    """Inverse of `encode_lanes`."""
    lanes = len(payloads)
    (size,) = struct.unpack_from("<I", payloads[0])
    model = Model(payloads[0][4 : 4 + size])
    coded = [payloads[0][4 + size :], *payloads[1:]]
    room = max(map(len, coded)) // 4 + 2
    words = np.zeros((lanes, room), "<u4")
    for row, p in zip(words, coded, strict=True):
        row[: len(p) // 4] = np.frombuffer(p, "<u4")
    code = words[:, 0].astype(np.int64) << 32 | words[:, 1]
    words, used = words.ravel(), np.arange(lanes, dtype=np.int64) * room + 2
    rng = np.full(lanes, (1 << WINDOW) - 1, np.int64)

    def move():
        m = (rng < LOW).nonzero()[0]
        if len(m):
            at = used[m]
            code[m] = code[m] << 32 | words[at]
            used[m] = at + 1
            rng[m] <<= 32

    out = np.empty((n, lanes), np.uint16)
    c1, c2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for j in range(n):
        if model.lists:
            lists = model.list_of(c1, c2)
            r = rng >> LIST_BITS
            v = (code / r).astype(np.int64)  # below 2**53, so exact
            entry = model.entry[lists * (LIST + 1) + model.rank_at(lists, v)]
            np.subtract(code, r * (entry >> 16 & 0xFFFF), out=code)
            np.multiply(r, entry & 0xFFFF, out=rng)
            move()
            x = entry >> 32
            m = (x < 0).nonzero()[0]
            r, c = rng[m] >> ID_BITS, code[m]
            y = model.by_share[(c / r).astype(np.int64)]
            code[m] = c - r * model.start[y]
            rng[m] = r * model.width[y]
            x[m] = y
        else:
            r = rng >> ID_BITS
            x = model.by_share[(code / r).astype(np.int64)].astype(np.int64)
            np.subtract(code, r * model.start[x], out=code)
            np.multiply(r, model.width[x], out=rng)
        move()
        out[j] = x
        c1, c2 = x, c1
    return np.ascontiguousarray(out.T)


# A frame: magic, ids, documents, bytes of payload, crc32 of all behind it; then for each document its id, flags and ids here; the payload.
MAGIC = b"EVT1"
HEAD = "<4sIIII"
ENTRY = np.dtype([("doc_id", "<i8"), ("flags", "u1"), ("ids", "<u4")])
NULL_ID, GOES_ON = 1, 2


def frame(ids: int, entries: np.ndarray, payload: bytes) -> bytes:
    body = entries.tobytes() + payload
    return struct.pack(HEAD, MAGIC, ids, len(entries), len(payload), zlib.crc32(body)) + body


def unframe(data: bytes) -> tuple[int, np.ndarray, bytes]:
    """Parts of a frame; raises on a wrong mark, length or checksum."""
    magic, ids, n, size, crc = struct.unpack_from(HEAD, data)
    body = data[struct.calcsize(HEAD) :]
    if magic != MAGIC or len(body) != n * ENTRY.itemsize + size or zlib.crc32(body) != crc:
        raise ValueError("damaged block")
    split = n * ENTRY.itemsize
    return ids, np.frombuffer(body[:split], ENTRY), body[split:]


def write_ids(docs: DataFrame, path: str, vocab: str, end_id: int = 1, block_ids: int = 4096, lanes: int = 2048) -> None:
    """Encode ``docs`` and write coded blocks of ids under ``path``, in ascending doc_id order.

    Rows are (part, block, frames): a part is a range of doc_ids, blocks follow
    each other within it. A row holds a group of up to ``lanes`` blocks from
    number ``block`` on and can be read alone; every block is checksummed, and
    the first has the model of the group. Null doc_ids come first; a null text
    has the end id alone; repeated rows stay, in any order among themselves.
    Ids must be below 65,536. An empty table writes no block.
    """

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        docs_in: deque[tuple[int, int, int]] = deque()  # doc_id, flags, ids left to write
        held: list[np.ndarray] = []
        count, block = 0, 0

        def flush(n: int):
            nonlocal count, block, held
            flat = np.concatenate(held)
            taken = min(len(flat), n * block_ids)
            grid = np.zeros(n * block_ids, np.uint16)
            grid[:taken] = flat[:taken]
            grid = grid.reshape(n, block_ids)[:, : taken if n == 1 else None]
            held, count = [flat[taken:]], len(flat) - taken
            frames = []
            left = taken
            for payload in encode_lanes(grid):
                room = here = min(block_ids, left)
                entries = []
                while room:
                    doc, flags, size = docs_in[0]
                    use = min(size, room)
                    entries.append((doc, flags, use))
                    if use == size:
                        docs_in.popleft()
                    else:
                        docs_in[0] = (doc, flags | GOES_ON, size - use)
                    room -= use
                left -= here
                frames.append(frame(here, np.array(entries, ENTRY), payload))
            out = pd.DataFrame({"part": [part], "block": [block], "frames": [frames]})
            block += n
            return out

        for pdf in batches:
            for doc, ids in zip(pdf["doc_id"], encode_texts(pdf["text"], vocab), strict=True):
                if len(ids) and ids.max() > 65535:
                    raise ValueError("an id is over 65,535")
                null = pd.isna(doc)
                docs_in.append((0 if null else int(doc), NULL_ID * null, len(ids) + 1))
                held.append(np.append(ids, end_id).astype(np.uint16))
                count += len(ids) + 1
                while count >= block_ids * lanes:
                    yield flush(lanes)
        if count:
            yield flush(-(-count // block_ids))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    # small row groups, as a reader takes one at a time
    ordered.mapInPandas(run, "part long, block long, frames array<binary>").write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(path)


def read_blocks(files: DataFrame) -> DataFrame:
    """Pieces of documents in groups of coded blocks: the group's first block, ids there and their crc32.

    A document is cut only where a group ends.
    """

    def run(batches):
        import pandas as pd

        def decoded(part, block, data):
            frames = [unframe(f) for f in data]
            grid = decode_lanes([f[2] for f in frames], max(f[0] for f in frames)).astype("<u4")
            out = []
            for row, (ids, entries, _) in zip(grid, frames, strict=True):
                at = 0
                for doc, flags, use in entries.tolist():
                    piece = row[at : at + use]
                    at += use
                    if flags & GOES_ON and out:
                        out[-1][5:] = out[-1][5] + use, zlib.crc32(piece, out[-1][6])
                    else:
                        out.append([part, block, len(out), None if flags & NULL_ID else doc, bool(flags & GOES_ON), use, zlib.crc32(piece)])
                if at != ids:
                    raise ValueError("damaged block index")
            out = pd.DataFrame(out, columns=["part", "block", "k", "doc_id", "goes_on", "ids", "crc"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            return out

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield decoded(*row)

    return files.mapInPandas(run, "part long, block long, k long, doc_id long, goes_on boolean, ids long, crc long")


def read_documents(files: DataFrame) -> DataFrame:
    """Per document of `write_ids` files: start (ids of all documents before it), n_tokens, crc32 of its ids.

    Documents that cross groups of blocks are put together from the crc32 of
    their pieces; running totals go through pieces and parts, never through one task.
    """
    pieces = read_blocks(files)
    by_part = Window.partitionBy("part").orderBy("block", "k")
    # the number of the document in its part; pieces that go on belong to the one before
    pieces = pieces.withColumn("no", F.sum((~F.col("goes_on")).cast("long")).over(by_part))
    pieces = pieces.withColumn("before", F.sum("ids").over(by_part) - F.col("ids"))
    ordered = F.sort_array(F.collect_list(F.struct("block", "ids", "crc")))
    docs = pieces.groupBy("part", "no").agg(F.first("doc_id").alias("doc_id"), F.min("before").alias("in_part"), F.sum("ids").alias("n_tokens"), ordered.alias("_p"))
    docs = settle(docs.drop("no"))
    joined = F.udf(lambda crcs, sizes: crc32_join(zip(crcs, [4 * s for s in sizes], strict=True)), "long")
    whole = docs.where(F.size("_p") == 1).withColumn("ids_crc32", F.col("_p")[0]["crc"])
    cut = docs.where(F.size("_p") > 1).withColumn("ids_crc32", joined("_p.crc", "_p.ids"))
    parts = docs.groupBy("part").agg(F.sum("n_tokens").alias("_t"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select("part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_shift"))
    return whole.union(cut).join(shifts, "part").select("doc_id", (F.col("in_part") + F.col("_shift")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocab: str, end_id: int = 1, block_ids: int = 4096) -> DataFrame:
    """Write the ids of ``docs`` to the shared folder and read them back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-ids")
    write_ids(docs, path, vocab, end_id, block_ids)
    return read_documents(spark.read.parquet(path))
