"""Jaccard join of word shingles by parity sketches."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.common import free_names, settle
from evispark.llm.components import connect, spanning_labels
from evispark.llm.phrases import BLANK, Words

U = np.uint64
SHORT = 8  # a run of equal block keys up to this length gives all its pairs at once
SKETCH_MIN = 256


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


_STEP = 0x9E3779B97F4A7C15
# Blanks end words, and nothing ends pieces.
_KINDS = np.zeros(256, np.uint8)
_KINDS[[32, 9, 10, 11, 12, 13]] = BLANK


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the number of words of each text.

    A prefix polynomial gives each word's hash without a loop over words, a
    stretch of bytes at a time, so a very long text takes some numbers a word
    beside its bytes. Letters A-Z count as lower case.
    """
    data = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    starts = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    words = Words(data, starts, kinds=_KINDS)
    return words.hash, np.bincount(words.text, minlength=len(texts))


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; the whole sequence if it is shorter than a shingle."""
    words, counts = word_hashes(texts)
    odd = [U(pow(_STEP, k + 3, 1 << 64)) for k in range(size)]
    n = len(words)
    rolled = np.zeros(max(0, n - size + 1), U)
    for k in range(size):
        rolled += words[k : n - size + 1 + k] * odd[k]
    rolled = mix(rolled)
    out, at = [], 0
    for c in counts.tolist():
        if c >= size:
            s = rolled[at : at + c - size + 1].copy()
            s.sort()
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif c:
            h = np.array([c], U)
            for w in words[at : at + c]:
                h = mix(h * U(31) ^ w)
            out.append(h)
        else:
            out.append(np.zeros(0, U))
        at += c
    return out


def level_of(n: int) -> int:
    return n.bit_length() - 1


def needs(n: int, level: int) -> tuple[int, int, int]:
    """(least partner, most differing shingles, blocks) of a set of n shingles on a level.

    On level l the smaller set of a pair has 2**l to 2**(l+1)-1 shingles, the
    larger at most 4/3 of that. Jaccard >= 3/4 allows (a + b) / 7 differing
    shingles. Blocks are so many that a pair leaves more equal blocks than
    empty ones even at the largest sizes.
    """
    small = (1 << level + 1) - 1
    partner = min(n * 4 // 3, small * 4 // 3) if n <= small else min(n, small)
    return partner, (n + partner) // 7, math.ceil(0.72 * (1 << level)) + 8


def block_keys(s: np.ndarray, level: int, blocks: int) -> tuple[np.ndarray, int]:
    """Keys of the blocks of the parity sketch that are not zero, and how many there are.

    Each shingle flips one bit of a sketch of ``blocks`` blocks of 2**40 bits;
    a block, nearly all zero, is held as the XOR of a code for each set bit.
    """
    h = mix(s + U((level + 1) * 0xA24BAED4963EE407 % (1 << 64)))
    block = ((h >> U(40)) * U(blocks) >> U(24)).astype(np.int64)
    code = mix(h & U((1 << 40) - 1) | U(1 << 41))
    order = np.argsort(block, kind="stable")
    block, code = block[order], code[order]
    first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    value = np.bitwise_xor.reduceat(code, first)
    block = block[first]
    live = value != 0
    return mix(value[live] ^ mix(block[live].astype(U) * U(64) + U(level))), int(live.sum())


def bit_sketch(s: np.ndarray) -> bytes:
    """Parity sketch of a power of two of bits, at least two a shingle; halves can be folded by XOR."""
    bits = max(SKETCH_MIN, 1 << (2 * len(s)).bit_length())
    at = np.bincount((mix(s ^ U(0x5851F42D4C957F2D)) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    # low bits of the position are the folding unit: halves of the vector line up
    return np.packbits(at.astype(np.uint8)).tobytes()


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of packed sketches; a bound from below on the symmetric difference."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def fold(sketch: bytes, size: int) -> np.ndarray:
    a = np.frombuffer(sketch, np.uint8)
    while len(a) > size:
        half = len(a) // 2
        a = a[:half] ^ a[half:]
    return a


def _texts(pdf):
    return [("" if t is None else t).encode() for t in pdf["text"]]


def _steps(texts, most=4 << 20):
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size < most or end == at):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def class_key(s: np.ndarray) -> int:
    """64-bit key of a sorted set: what equal sets share and others do not."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def summarise(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, h, n_shingles, rep, sketch) of ``docs`` (doc_id, h, text); rep: class of equal sets, null if empty."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            texts = _texts(pdf)
            sets = [s for at, end in _steps(texts) for s in shingle_sets(texts[at:end], size)]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"].astype("Int64"), "h": pdf["h"], "n_shingles": [len(s) for s in sets],
                    "rep": pd.array([class_key(s) if len(s) else None for s in sets], dtype="Int64"), "sketch": [bit_sketch(s) if len(s) else None for s in sets],
                }
            )

    return docs.mapInPandas(run, "doc_id long, h long, n_shingles long, rep long, sketch binary")


def candidate_runs(docs: DataFrame, parts: int, size: int = 5) -> DataFrame:
    """Pairs and long runs of classes of ``docs`` (text) that agree on a block.

    Each task turns its documents, copies once, into block keys and packs them
    by ``parts`` ranges of keys, so the shuffle moves a few bytes a key. A
    range's task sorts its keys: a run of up to SHORT classes gives all its
    pairs, a longer one its pairs with the first class and a row a member.
    """

    def emit(batches):
        import pandas as pd

        for pdf in batches:
            texts = _texts(pdf)
            for at, end in _steps(texts):
                keys, owner, slack, lev = [], [], [], []
                sets = {class_key(s): s for s in shingle_sets(texts[at:end], size) if len(s)}
                for rep, s in sorted(sets.items()):
                    n = len(s)
                    top = level_of(n)
                    # as the smaller set on its own level, as the larger one on the level below
                    for level in {top, level_of(-(-3 * n // 4))}:
                        _, differ, blocks = needs(n, level)
                        k, live = block_keys(s, level, blocks)
                        if live <= differ:  # an equal block may be a zero one: those count as well
                            zeros = np.arange(blocks, dtype=U) * U(64) + U(level)
                            k = np.concatenate((k, mix(mix(zeros) ^ U(0x1F83D9ABFB41BD6B))))
                        keys.append(k)
                        owner.append(np.full(len(k), rep))
                        slack.append(np.full(len(k), max(0, live - differ)))
                        lev.append(np.full(len(k), level))
                if not keys:
                    continue
                keys, owner, slack, lev = map(np.concatenate, (keys, owner, slack, lev))
                part = (keys >> U(32)) * U(parts) >> U(32)
                order = np.argsort(part, kind="stable")
                keys, owner, slack, lev, part = keys[order], owner[order], slack[order], lev[order], part[order]
                first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                last = np.append(first[1:], len(part))
                rows = []
                for i, j in zip(first, last, strict=True):
                    new = np.concatenate(([True], (owner[i + 1 : j] != owner[i : j - 1]) | (lev[i + 1 : j] != lev[i : j - 1])))
                    begin = np.flatnonzero(new)
                    rows.append(
                        (
                            int(part[i]), (keys[i:j] & U(0xFFFFFFFF)).astype("<u4").tobytes(), np.diff(np.append(begin, j - i)).astype("<u4").tobytes(), owner[i:j][begin].astype("<i8").tobytes(),
                            np.minimum(slack[i:j][begin], 65535).astype("<u2").tobytes(), lev[i:j][begin].astype("u1").tobytes(),
                        )
                    )
                yield pd.DataFrame(rows, columns=["part", "keys", "counts", "reps", "slack", "level"])

    def meet(pdf):
        import pandas as pd

        part = int(pdf["part"].iloc[0])
        cat = lambda c, t: np.frombuffer(b"".join(pdf[c]), t)
        counts = cat("counts", "<u4")
        key = cat("keys", "<u4")
        at = np.repeat(np.arange(len(counts)), counts)
        reps, slack, level = cat("reps", "<i8"), cat("slack", "<u2"), cat("level", "u1")
        order = np.lexsort((reps[at], key))
        key, at = key[order], at[order]
        once = np.concatenate(([True], (key[1:] != key[:-1]) | (reps[at[1:]] != reps[at[:-1]])))
        key, at = key[once], at[once]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(key)))
        pairs = []
        for n in range(2, SHORT + 1):
            begin = first[size == n]
            if len(begin):
                rows = begin[:, None] + np.arange(n)
                a, b = np.triu_indices(n, 1)
                pairs.append(np.stack([reps[at[rows[:, a]]].ravel(), reps[at[rows[:, b]]].ravel()]))
        long_runs = np.flatnonzero(size > SHORT)
        inside = np.concatenate([np.arange(first[i], first[i] + size[i]) for i in long_runs]) if len(long_runs) else np.zeros(0, np.int64)
        head = np.repeat(first[long_runs], size[long_runs])
        if len(inside):
            pairs.append(np.stack([reps[at[head]], reps[at[inside]]]))
        out = []
        if pairs:
            p = np.concatenate(pairs, axis=1)
            p = np.unique(p[:, p[0] != p[1]], axis=1)
            out.append(pd.DataFrame({"kind": 0, "a": p.min(axis=0), "b": p.max(axis=0), "run": 0, "level": 0, "slack": 0}))
        if len(inside):
            out.append(
                pd.DataFrame({"kind": 1, "a": reps[at[inside]], "b": 0, "run": part * (1 << 32) + key[inside].astype(np.int64), "level": level[at[inside]], "slack": slack[at[inside]]})
            )
        cols = ["kind", "a", "b", "run", "level", "slack"]
        return pd.concat(out)[cols] if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in cols})

    blobs = docs.mapInPandas(emit, "part long, keys binary, counts binary, reps binary, slack binary, level binary")
    return blobs.groupBy("part").applyInPandas(meet, "kind int, a long, b long, run long, level int, slack int")


def verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, size: int = 5) -> DataFrame:
    """Pairs (a, b) of ``reps`` with 100 * intersection >= 75 * union.

    Only sizes and sketches move for all pairs; shingles, made from ``texts``
    (doc_id, h, text), only for classes with a Hamming distance that leaves the
    threshold possible.
    """

    @F.pandas_udf("boolean")
    def near(na, sa, nb, sb):
        import pandas as pd

        out = []
        for n, s, m, t in zip(na, sa, nb, sb, strict=True):
            size = min(len(s), len(t))
            ok = 4 * min(n, m) >= 3 * max(n, m)
            out.append(ok and 7 * int(hamming(fold(s, size), fold(t, size))) <= n + m)
        return pd.Series(out, dtype=bool)

    @F.pandas_udf("boolean")
    def similar(sa, sb):
        import pandas as pd

        out = []
        for s, t in zip(sa, sb, strict=True):
            x, y = np.frombuffer(s, U), np.frombuffer(t, U)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= 75 * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    def side(k):
        return reps.select(F.col("rep").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))

    close = settle(pairs.join(side("a"), "a").join(side("b"), "b").filter(near("na", "sa", "nb", "sb")).select("a", "b"))
    asked = close.select(F.col("a").alias("rep")).union(close.select("b")).distinct().join(reps.select("rep", "doc_id", "h"), "rep")
    one_text = texts.join(asked, ["doc_id", "h"]).select("rep", "text").dropDuplicates(["rep"])
    sets = settle(shingle_table(one_text, size))

    def full(k):
        return sets.select(F.col("rep").alias(k), F.col("shingles").alias(f"x{k}"))

    return close.join(full("a"), "a").join(full("b"), "b").filter(similar("xa", "xb")).select("a", "b")


def shingle_table(docs: DataFrame, size: int = 5) -> DataFrame:
    """(rep, shingles) of ``docs`` (rep, text)."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            texts = _texts(pdf)
            for at, end in _steps(texts):
                sets = shingle_sets(texts[at:end], size)
                yield pd.DataFrame({"rep": pdf["rep"].iloc[at:end].to_numpy(np.int64), "shingles": [s.tobytes() for s in sets]})

    return docs.mapInPandas(run, "rep long, shingles binary")


def rest_members(runs: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, run, component) of long runs that are still apart, of members that long runs alone could link.

    A member with more equal-able blocks outside long runs than the allowed
    difference has met every partner in a short run, so it may go.
    """
    lost = runs.groupBy("a", "level").agg(F.countDistinct("run").alias("w"), F.min("slack").alias("slack")).filter("w >= slack").select("a", "level")
    left = runs.join(lost, ["a", "level"]).select("a", "run").distinct().join(labels.withColumnRenamed("node", "a"), "a", "left")
    left = left.withColumn("component", F.coalesce("component", "a"))
    mixed = left.groupBy("run").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("run")
    return left.join(mixed, "run")


def common_counts(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the shingles that two sets or more have."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[col] > 1
    place = np.cumsum(n > 1) - 1
    col, owner = place[col[shared]], owner[shared]
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        lo, hi = np.searchsorted(col, (at, at + width))
        x = np.zeros((len(sets), width), np.float32)
        x[owner[lo:hi], col[lo:hi] - at] = 1
        out += x @ x.T
    return out


def rest_edges(left: DataFrame, reps: DataFrame, texts: DataFrame, size: int = 5, block: int = 800, block_shingles: int = 500_000) -> DataFrame:
    """Edges (a, b) that join the parts of long runs which are linked, from `rest_members`.

    Runs of one group of near copies have much the same members, so runs that
    share a member are taken together as one crowd. A crowd's members meet by
    blocks of about ``block`` members and ``block_shingles`` shingles, one task
    a pair of blocks, which counts all intersections exactly and returns a
    spanning forest: a row a member at most, whatever the number of pairs.
    """
    firsts = left.groupBy("run").agg(F.min("a").alias("b"))
    crowds = connect(left.join(firsts, "run").select("a", "b").distinct()).select(F.col("node").alias("a"), F.col("component").alias("crowd"))
    members = settle(left.select("a", "component").distinct().join(crowds, "a").join(reps.select(F.col("rep").alias("a"), "doc_id", "h", "n"), "a"))
    sets = shingle_table(texts.join(members.select(F.col("a").alias("rep"), "doc_id", "h"), ["doc_id", "h"]).select("rep", "text").dropDuplicates(["rep"]), size)
    sets = settle(sets).withColumnRenamed("rep", "a")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / block_shingles)).cast("int")
    placed = members.join(members.groupBy("crowd").agg(blocks.alias("m")), "crowd").withColumn("blk", F.pmod(F.xxhash64("a"), F.col("m")).cast("int"))
    partner = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: F.struct(F.least(o, F.col("blk")).alias("lo"), F.greatest(o, F.col("blk")).alias("hi")))
    cells = placed.withColumn("cell", F.explode(partner)).select("crowd", "cell.lo", "cell.hi", "a", "component").join(sets, "a")

    def meet(pdf):
        import pandas as pd

        pdf = pdf.sort_values("a")
        a, comp = pdf["a"].to_numpy(np.int64), pdf["component"].to_numpy(np.int64)
        sets = [np.frombuffer(x, U) for x in pdf["shingles"]]
        n = np.array([len(x) for x in sets])
        i, j = np.nonzero(np.triu(175 * common_counts(sets) >= 75 * (n[:, None] + n), 1))
        apart = comp[i] != comp[j]
        # members of one component hang together already
        _, first, group = np.unique(comp, return_index=True, return_inverse=True)
        label = spanning_labels(np.concatenate((i[apart], np.arange(len(a)))), np.concatenate((j[apart], first[group])), len(a))
        moved = a[label] != a[first[group]]
        return pd.DataFrame({"a": a[moved], "b": a[label[moved]]})

    return cells.groupBy("crowd", "lo", "hi").applyInPandas(meet, "a long, b long").distinct()


def labelled(docs: DataFrame, size: int = 5, part_keys: int = 500_000) -> DataFrame:
    """(doc_id, h, n_shingles, component_id, c) for each row of ``docs``: `near_duplicates` with the hash of the text and a number of the component.

    Components that share an id, as their smallest rows do, have numbers of their own; rows that link with nothing have none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    info = settle(summarise(rows, size))
    usable = info.filter("doc_id is not null and rep is not null")
    first = F.min(F.struct("doc_id", "h"))
    classes = usable.groupBy("rep").agg(first.alias("f"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    reps = settle(classes.select("rep", "f.doc_id", "f.h", "n", "sketch"))
    # about two block keys for three shingles
    total = info.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(8, math.ceil(total * 2 / 3 / part_keys))
    found = settle(candidate_runs(rows.filter("doc_id is not null").select("text"), parts, size))
    pairs = found.filter("kind = 0").select("a", "b").distinct()
    runs = found.filter("kind = 1").select("a", "run", "level", "slack")
    edges = settle(verified(pairs, reps, rows, size))
    labels = settle(connect(edges))
    left = settle(rest_members(runs, labels))
    if not left.isEmpty():
        labels = settle(connect(edges.union(rest_edges(left, reps, rows, size))))
    # classes are numbered by hash; a component is named by its smallest doc_id
    named = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "doc_id", F.coalesce("component", "rep").alias("c"))
    names = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    by_class = named.join(names, "c").select("rep", "component_id", "c")
    salted = info.withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(32)))
    wide = salted.select("rep", "_s").distinct().join(by_class, "rep")
    out = salted.join(wide, ["rep", "_s"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "h", "n_shingles", own.alias("component_id"), "c")


def near_duplicates(docs: DataFrame, size: int = 5, part_keys: int = 500_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    Documents link when 100 * intersection >= 75 * union of their sets of
    ``size``-word shingles; ``component_id`` is the smallest doc_id reachable.
    Equal sets form one class, whose smallest doc_id stands for all copies.
    Classes that agree on a block of their parity sketches are candidates:
    every linked pair does, as it differs in fewer shingles than there are
    blocks. Empty sets (null text, no words) link with nothing. Rows with a null
    doc_id get their count but link with nothing. Rows that repeat a doc_id are
    documents of their own under one id. Very long texts are read whole, a
    stretch at a time. No rows give no rows.
    """
    return labelled(docs, size, part_keys).drop("h", "c")


def keep_first(docs: DataFrame, size: int = 5) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest doc_id, then the smallest hash of its text.

    Rows are told apart by id and text, so of two different texts under one id
    each has its own fate, and of equal rows one stays. Rows that link with
    nothing (null ids, empty sets) all stay. Only the keys of rows that go, or
    that are there more than once, meet the documents.
    """
    found = labelled(docs.select("doc_id", "text"), size).filter("doc_id is not null and c is not null")
    keys = found.groupBy("doc_id", "h", "c").agg(F.count(F.lit(1)).alias("n"))
    best = keys.groupBy("c").agg(F.min(F.struct("doc_id", "h")).alias("b"))
    gone = F.struct("doc_id", "h") != F.col("b")
    i, h, out = free_names(docs, "_id", "_hash", "_gone")
    fate = keys.join(best, "c").select(F.col("doc_id").alias(i), F.col("h").alias(h), gone.alias(out), "n").filter(F.col(out) | (F.col("n") > 1)).drop("n")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & F.xxhash64(F.col("text").cast("string")).eqNullSafe(F.col(h))
    kept = docs.join(settle(fate), same, "left").filter(~F.coalesce(F.col(out), F.lit(False)))
    # rows met here without a fate of their own are there once; the others are few
    once, more = kept.filter(F.col(out).isNull()), kept.filter(F.col(out).isNotNull())
    return once.unionByName(more.dropDuplicates([i, h])).drop(i, h, out)
