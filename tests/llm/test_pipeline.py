"""The pipeline stage by stage, on a small table with planted cases."""

from __future__ import annotations

import random

import corpus_pipeline
from evispark.llm import packing
from evispark.llm.common import vocabulary

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ter", "an", "se"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    clean = [prose(rng, 80) for _ in range(20)]
    passage = prose(rng, 60)
    near = clean[0].split()
    near[40] = "other"
    texts = [*clean, " ".join(near), f"{prose(rng, 30)}\n{passage}", f"{prose(rng, 30)}\n{passage}\n{prose(rng, 9)}", None, "", "12 34 !!", f"{prose(rng, 40)} 4207051279108084 {prose(rng, 4)}"]
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in enumerate(texts)], DDL)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(kept["language ID"]) == {*range(23), 26}
    assert kept["line dedup"][21] == texts[21] and passage not in kept["line dedup"][22] and kept["line dedup"][22].count("\n") == 1
    assert set(kept["near duplicates"]) == {*range(20), 21, 22, 26}
    assert "4207051279108084" not in kept["PII"][26] and all(kept["PII"][i] == clean[i] for i in range(20))
    rows = docs.collect()
    assert {r["doc_id"] for r in rows} == set(kept["PII"])
    assert len({r["sequence_id"] for r in rows}) == packing.lower_bound(__import__("numpy").array([r["length"] for r in rows]), 2048)


def test_empty_and_repeated(spark, tmp_path):
    docs = spark.createDataFrame([], DDL)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0 and vocabulary("byte_bpe_50k.json")
