"""Near-duplicate embeddings by cross-polytope hashing."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.common import settle
from evispark.llm.components import connect, spanning_labels

THRESHOLD = 0.95


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, in log2(width) passes."""
    x, h = x.copy(), 1
    while h < x.shape[1]:
        v = x.reshape(len(x), -1, 2, h)
        x = np.stack([v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]], axis=2).reshape(len(x), -1)
        h *= 2
    return x / np.sqrt(x.shape[1])


def polytope_codes(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """Buckets of unit rows: (rows, tables, probes) numbers, the nearest bucket first.

    Each hash rotates by three rounds of random signs and a Hadamard transform
    and takes the nearest vertex of the cross polytope. Further probes replace,
    in one hash at a time, the nearest vertex by the second nearest, those that
    lose least first.
    """
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    wide = np.zeros((len(x), width))
    wide[:, : x.shape[1]] = x
    rng = np.random.default_rng(seed)
    out = np.zeros((len(x), tables, probes), np.int64)
    rows = np.arange(len(x))
    for t in range(tables):
        first, second, loss = [], [], []
        for _ in range(hashes):
            y = wide
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            size = np.abs(y)
            top = np.argpartition(-size, 1, axis=1)[:, :2]
            swap = size[rows, top[:, 0]] < size[rows, top[:, 1]]
            top[swap] = top[swap][:, ::-1]
            for k, into in ((0, first), (1, second)):
                into.append(top[:, k] * 2 + (y[rows, top[:, k]] < 0))
            loss.append(size[rows, top[:, 0]] - size[rows, top[:, 1]])
        first, second, loss = np.array(first), np.array(second), np.array(loss)
        scale = (2 * width) ** np.arange(hashes, dtype=np.int64)
        home = (first * scale[:, None]).sum(axis=0)
        out[:, t, 0] = home
        order = np.argsort(loss, axis=0)
        for p in range(1, probes):
            h = order[p - 1]
            out[:, t, p] = home + (second[h, rows] - first[h, rows]) * scale[h]
    return out


def link(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = 10, hashes: int = 3, probes: int = 4, block: int = 1000, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding).

    Equal vectors form one class, which alone is hashed. Each class goes to
    ``probes`` buckets of each of ``tables`` tables; a bucket is cut into blocks
    of about ``block`` classes, and each pair of blocks of a bucket meets in one
    place, which verifies all pairs by cosine in double precision. A pair counts
    in the first bucket that its members share, so each task returns one count
    a class and the edges of a spanning forest, never all pairs. A bucket of any
    size is done whole; it only takes more tasks.

    Null, zero and non-finite vectors (also null or missing components) link
    with nothing; so do vectors of another width. A null vec_id keeps its row
    and its count of links, and gets no component of its own. Repeated rows are
    vectors of their own. No rows give no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = F.coalesce(F.col("e").isNotNull() & finite & F.exists("e", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("_class", F.when(valid, F.sha2(F.array_join(F.transform("e", lambda v: (v + 0.0).cast("string")), ","), 256)))
    members = settle(rows.filter("_class is not null").select("vec_id", "_class", "e"))
    classes = settle(members.groupBy("_class").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("size"), F.first("e").alias("e")).withColumn("key", F.xxhash64("_class")))

    def hashed(batches):
        import pandas as pd

        for pdf in batches:
            for width, part in pdf.groupby(pdf["e"].map(len)):
                x = np.array(part["e"].tolist(), dtype=np.float64)
                x = x / np.abs(x).max(axis=1)[:, None]
                x = x / np.sqrt((x * x).sum(axis=1))[:, None]
                codes = polytope_codes(x, tables, hashes, probes, seed).reshape(len(part), -1)
                yield pd.DataFrame(
                    {"key": part["key"].to_numpy(), "size": part["size"].to_numpy(), "width": width, "x": list(map(bytes, x)), "codes": list(map(bytes, codes)), "buckets": codes.tolist()}
                )

    rotated = settle(classes.select("key", "size", "e").mapInPandas(hashed, "key long, size long, width int, x binary, codes binary, buckets array<long>"))
    slots = rotated.select("key", "width", F.posexplode("buckets").alias("p", "bucket")).select("key", "width", F.expr(f"cast(p div {probes} as int)").alias("t"), "bucket").distinct()
    slots = settle(slots)
    counts = slots.groupBy("width", "t", "bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    counts = counts.withColumn("m", F.ceil(F.col("n") / block).cast("int"))
    # only now the vectors join, for buckets that two classes or more share
    met = slots.join(counts, ["width", "t", "bucket"]).withColumn("b", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("m")).cast("int"))
    partner = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: F.struct(F.least(o, F.col("b")).alias("lo"), F.greatest(o, F.col("b")).alias("hi")))
    cells = settle(met.withColumn("cell", F.explode(partner)).select("key", "width", "t", "bucket", "cell.lo", "cell.hi", "b"))
    # small cells share a task: one call of Python for some ten thousand rows
    tasks = max(1, math.ceil(cells.count() / 20_000))
    cells = cells.withColumn("task", F.pmod(F.xxhash64("width", "t", "bucket", "lo", "hi"), F.lit(tasks))).join(rotated.drop("width", "buckets"), "key")
    table = np.repeat(np.arange(tables), probes)

    def links_in(key, size, x, codes, b, t, bucket, lo, hi):
        """(i, j) of the cell's linked pairs for which this is the first bucket that both are in."""
        found = []
        for at in range(0, len(key), 256):
            i, j = np.nonzero(x[at : at + 256] @ x.T >= threshold)
            i = i + at
            ok = (i < j) & ((lo == hi) | (b[i] != b[j]))
            i, j = i[ok], j[ok]
            first = np.ones(len(i), bool)
            for t2 in range(t + 1):
                own = np.flatnonzero(table == t2)
                for p in own if len(i) else ():
                    for q in own:
                        same = codes[i, p] == codes[j, q]
                        if t2 == t:
                            same &= codes[i, p] < bucket
                        first &= ~same
            found.append((i[first], j[first]))
        return tuple(np.concatenate(v) for v in zip(*found, strict=True))

    def verify(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["width", "t", "bucket", "lo", "hi", "key"])
        spots = pdf[["width", "t", "bucket", "lo", "hi"]].to_numpy(np.int64)
        begin = np.flatnonzero(np.concatenate(([True], (spots[1:] != spots[:-1]).any(axis=1))))
        key, size, b = (pdf[c].to_numpy(np.int64) for c in ("key", "size", "b"))
        xs, cs = pdf["x"].to_numpy(), pdf["codes"].to_numpy()
        out = []
        for lo_row, end in zip(begin, np.append(begin[1:], len(pdf)), strict=True):
            w = slice(lo_row, end)
            x, codes = np.stack([np.frombuffer(v) for v in xs[w]]), np.stack([np.frombuffer(v, np.int64) for v in cs[w]])
            _, t, bucket, lo, hi = spots[lo_row].tolist()
            i, j = links_in(key[w], size[w], x, codes, b[w], t, bucket, lo, hi)
            if not len(i):
                continue
            links = np.bincount(i, size[w][j], len(x)) + np.bincount(j, size[w][i], len(x))
            label = spanning_labels(i, j, len(x))
            hit = links > 0
            out.append(pd.DataFrame({"key": key[w][hit], "links": links[hit].astype(np.int64), "root": key[w][label[hit]]}))
        return pd.concat(out) if out else pd.DataFrame({"key": key[:0], "links": key[:0], "root": key[:0]})

    found = settle(cells.groupBy("task").applyInPandas(verify, "key long, links long, root long"))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    ids = classes.select("key", "id")
    edges = found.filter("key != root").select("key", "root").distinct()
    edges = edges.join(ids, "key").withColumnRenamed("id", "a").join(ids.withColumnRenamed("key", "root").withColumnRenamed("id", "b"), "root").select("a", "b")
    labels = connect(edges)
    out = classes.join(links, "key", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
    out = out.select("_class", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    # a class of any size is met in up to 32 tasks
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(32))
    salted = members.select("vec_id", "_class", salt.alias("_s"))
    wide = salted.select("_class", "_s").distinct().join(out, "_class")
    linked = salted.join(wide, ["_class", "_s"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("_class is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
