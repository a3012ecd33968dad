"""Token counts against the libraries, and what the cache is asked for."""

from __future__ import annotations

import random

import pytest

from evispark.llm import tokencount
from evispark.llm.common import tokenizer, vocabulary

DDL = "doc_id long, text string, digest string, d string, n_tokens string, version string, lang string"
BYTE, WORD, PIECE = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json"), vocabulary("piece_bpe_32k.model")
ODD = ["", None, " ", "Hello <|endoftext|> it's  \n\n 42  done\u001c now\t\t", "é中\U0001f600  x  y", "<|endoftext|><|endoftext|>", "a" * 3000 + " b", " \n" * 500 + "x  y", "İ ß ſ\u0085z"]


def texts():
    rng = random.Random(2)
    return [*ODD, *[" ".join(rng.choice(["the", "cat", "Über", "naïve", "12", "x=1;", "\n", ""]) for _ in range(rng.randrange(60))) for _ in range(60)], ODD[3], ODD[3]]


def expected(path, text):
    if path == PIECE:
        import sentencepiece

        return len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text or ""))
    return len(tokenizer(path).encode(text or "", add_special_tokens=False).ids)


def asked(monkeypatch, seen):
    real = tokencount.encode_misses

    def spy(df, path, version):
        seen.append(df.count())
        return real(df, path, version)

    monkeypatch.setattr(tokencount, "encode_misses", spy)


@pytest.mark.parametrize("path", [BYTE, WORD, PIECE])
def test_counts_are_the_library_s(spark, tmp_path, path):
    rows = [(i if i % 9 else None, t, "x", "y", "z", "v", "en") for i, t in enumerate(texts())]
    out = tokencount.count_tokens(spark.createDataFrame(rows, DDL).repartition(3), path, str(tmp_path / "cache"), limit=20).collect()
    want = sorted((r[0] or -1, len((r[1] or "").encode()), expected(path, r[1]), expected(path, r[1]) > 20) for r in rows)
    assert sorted((r["doc_id"] or -1, *tuple(r)[1:]) for r in out) == want


def test_only_distinct_misses_are_encoded(spark, tmp_path, monkeypatch):
    cache, seen = str(tmp_path / "cache"), []
    asked(monkeypatch, seen)
    table = lambda ts: spark.createDataFrame([(i, t, *"xyzv", "en") for i, t in enumerate(ts)], DDL)
    tokencount.count_tokens(table(["a", "a", "b", None, ""]), BYTE, cache).collect()
    assert seen == [3]
    tokencount.count_tokens(table(["a", "b", "b"]), BYTE, cache).collect()
    assert seen == [3]
    tokencount.count_tokens(table(["a", "c", "c", "d"]), BYTE, cache).collect()
    assert seen == [3, 2]
    monkeypatch.setattr(tokencount, "BROADCAST_BYTES", 0)
    assert {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(table(["a", "e f g"]), BYTE, cache).collect()} == {0: 1, 1: 3}
    assert seen == [3, 2, 1]
    tokencount.count_tokens(table(["a", "c"]), WORD, cache).collect()  # another tokenizer knows nothing yet
    assert seen == [3, 2, 1, 2]
    rows = spark.read.parquet(cache)
    assert rows.count() == 8 and rows.select("version").distinct().count() == 2
    rows.write.mode("append").partitionBy("version").parquet(cache)  # as if two jobs had stored the same
    assert tokencount.count_tokens(table(["a", "b", "b"]), BYTE, cache).count() == 3


def test_stretches_give_the_same_tokens():
    count = tokencount.counter(BYTE, step=7)
    ts = [t or "" for t in texts()] + ["<|endoftext|> <|endoftext|>\n" * 20, "x" * 100, "a  b\n\n\nc \t d" * 30]
    assert count(ts) == [expected(BYTE, t) for t in ts]
    for t in ts:
        assert "".join(tokencount.cuts(t, 7)) == t
    assert tokencount.cuts_at_blanks(BYTE) and not tokencount.cuts_at_blanks(WORD)
    assert tokencount.counter(BYTE)([" " * 300_000 + "x"]) == [tokencount.counter(BYTE, step=10**9)([" " * 300_000 + "x"])[0]]


def test_version_follows_the_file(tmp_path):
    copy = tmp_path / "other.json"
    with open(BYTE, "rb") as f:
        copy.write_bytes(f.read())
    assert tokencount.version_of(str(copy)) == tokencount.version_of(BYTE) != tokencount.version_of(WORD)


def test_empty_table(spark, tmp_path):
    cache = str(tmp_path / "cache")
    assert tokencount.count_tokens(spark.createDataFrame([], DDL), BYTE, cache).count() == 0
    assert tokencount.count_tokens(spark.createDataFrame([], DDL), BYTE, cache).count() == 0
