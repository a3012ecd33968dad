"""Snapshots, copy-on-write upserts, and ingest whose state is bounded."""

from __future__ import annotations

import json
import os

import pytest

from evispark.errors import BundleFormatError, EvidenceError
from evispark.sources import snapshots
from evispark.streaming.log import ingest_stream

DDL = "k string, seq bigint, v string"


def tree(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def test_upsert_writes_only_touched_buckets(spark, tmp_path):
    root = str(tmp_path / "t")
    table = lambda *rows: spark.createDataFrame(rows, DDL)
    rows = {f"k{i}": (f"k{i}", 1, f"v{i}") for i in range(200)}
    touched = snapshots.upsert(table(*rows.values()), root, ["k"], "seq", buckets=16)
    assert touched == list(range(16)) and snapshots.version(spark, root) == 1
    before, at = tree(root), snapshots.committed(spark, root)["at"]
    new = [("k3", 2, "newer"), ("k3", 3, "newest"), ("k4", 0, "older"), ("fresh", 1, "x"), (None, 1, "null key")]
    touched = snapshots.upsert(table(*new), root, ["k"], "seq", buckets=99)
    after = snapshots.committed(spark, root)["at"]
    assert 0 < len(touched) <= 4 and {b for b in after if after[b] != at.get(b)} == {str(b) for b in touched}
    assert all(tree(root)[f] == t for f, t in before.items())  # nothing that was there is written again
    rows |= {"k3": new[1], "fresh": new[3], None: new[4]}
    got = {r.k: tuple(r) for r in snapshots.read(spark, root, DDL).collect()}
    assert got == rows
    assert snapshots.read(spark, root, DDL, 1).count() == 200  # the version before can still be read
    assert snapshots.upsert(table(), root, ["k"], "seq") == [] and snapshots.version(spark, root) == 2


def test_two_writers_of_one_version(spark, tmp_path):
    root = str(tmp_path / "t")
    snapshots.commit(spark, root, 1, {"folder": "a"})
    with pytest.raises(EvidenceError):
        snapshots.commit(spark, root, 1, {"folder": "b"})
    assert snapshots.committed(spark, root) == {"folder": "a"} and snapshots.version(spark, root) == 1
    assert [f for f in os.listdir(tmp_path / "t" / "_commits") if f.startswith("part")] == []


def test_readers_see_the_old_snapshot_or_the_new(spark, tmp_path):
    root, seen = str(tmp_path / "bundle"), []
    assert snapshots.current(spark, root) is None

    def build(n):
        def to(folder):
            seen.append(snapshots.current(spark, root))
            spark.range(n).write.parquet(folder)

        return to

    def verify(folder):
        seen.append(snapshots.current(spark, root))
        if spark.read.parquet(folder).count() == 7:
            raise BundleFormatError("seven")

    first = snapshots.publish(spark, root, build(3), verify)
    assert snapshots.current(spark, root) == first and spark.read.parquet(first).count() == 3
    with pytest.raises(BundleFormatError):
        snapshots.publish(spark, root, build(7), verify)
    assert snapshots.current(spark, root) == first
    second = snapshots.publish(spark, root, build(5), verify)
    assert snapshots.current(spark, root) == second != first and spark.read.parquet(first).count() == 3
    assert seen == [None, None, first, first, first, first]


def test_ingest_keeps_a_bounded_state(spark, tmp_path):
    (tmp_path / "in").mkdir()
    box, store, dead, ck = (str(tmp_path / n) for n in ("in", "store", "dead", "ck"))
    line = lambda k, day, e=None: json.dumps({"k": k, "recorded_at": f"2026-01-{day:02d}T00:00:00Z", "error": e})
    schema = "k string, recorded_at timestamp, error string"

    def run(name, *lines):
        (tmp_path / "in" / name).write_text("\n".join(lines))
        good, bad = ingest_stream(spark, box, schema, ["k"], store, dead, ck, look_back="2 days")
        good.awaitTermination()
        bad.awaitTermination()
        told = [p for p in good.recentProgress if p["stateOperators"]]
        return told[-1]["stateOperators"][0]["numRowsTotal"] if told else None

    run("1.json", line("a", 1), line("a", 1), line("b", 1, "boom"), line("c", 2))
    run("2.json", line("a", 2), line("d", 3))  # a again, within the look-back
    kept = [run(f"{i}.json", *[line(f"day{i}-{j}", i) for j in range(10)], line("c", 2)) for i in range(4, 20)]
    assert max(kept) <= 50  # ten keys a day, 160 in all: those of the look-back only
    got = sorted(r.k for r in spark.read.parquet(store).collect())
    assert got == sorted(["a", "c", "d", *[f"day{i}-{j}" for i in range(4, 20) for j in range(10)]])
    assert [r.k for r in spark.read.json(dead).collect()] == ["b"]
    good, bad = ingest_stream(spark, box, schema, ["k"], store, dead, ck, look_back="2 days")  # started anew: nothing new
    good.awaitTermination()
    bad.awaitTermination()
    assert spark.read.parquet(store).count() == len(got)
