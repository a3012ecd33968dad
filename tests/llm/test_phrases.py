"""Collocations against plain counting, and the arrays beneath them."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from evispark.llm import phrases

DDL = "doc_id long, text string, lang string, print string, n long, word string, a string, rank string, score string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_counts(rows):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 6):
                for i in range(len(w) - n + 1):
                    f[lang][" ".join(w[i : i + n])] += 1
    return f, total


def plain(rows, least, top):
    f, total = plain_counts(rows)
    out = []
    for lang, counts in f.items():
        n, kept = total[lang], []
        frequent = {p: a for p, a in counts.items() if " " in p and a >= least}
        around = Counter()
        for p, a in frequent.items():
            w = p.split(" ")
            for size in range(2, len(w)):
                for i in range(len(w) - size + 1):
                    q = " ".join(w[i : i + size])
                    around[q] = max(around[q], a)
        for p, a in frequent.items():
            w = p.split(" ")
            cuts = [(1000 * a * n // (counts[" ".join(w[:k])] * counts[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            if 100 * around[p] < 100 * a:
                kept.append((-score, -a, p.encode(), counts[" ".join(w[:k])], counts[" ".join(w[k:])]))
        out += [(lang, i, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(12)] + ["Éa", "中文", "x y", "don't", "İz"]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            parts.append(rng.choice(["in the Middle of nowhere", "new York City", " ".join(rng.choices(vocab, k=rng.randrange(1, 9)))]))
        text = rng.choice([". ", ", ", "\n", "\x0b", "\t", "  "]).join(parts)
        rows.append((i, text, rng.choice(["en", "en", "en", "de", None, "und"])))
    rows += [(900, None, "en"), (901, "", "en"), (902, " \t. ,", None), (903, "word " * 4000, "de"), (903, "word " * 4000, "de"), (None, rows[0][1], "en"), (904, "q" * 300_000 + " tail tail", "en")]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z", "u", "v") for r in rows], DDL).repartition(4)


@pytest.mark.parametrize(("least", "top", "bits", "step"), [(20, 10**6, 64, 1 << 24), (8, 25, 64, 3000), (20, 100, 9, 20_000)])
def test_collocations_are_exact(spark, rows, least, top, bits, step):
    out = phrases.collocations(table(spark, rows), least, top=top, filter_bits=14, hash_bits=bits, step=step)
    got = sorted(tuple(r)[:8] for r in out.collect())
    assert got == plain(rows, least, top) and len(got) > 10


def test_pointers_lead_to_the_phrase(spark, rows):
    texts = {i: lowered(t).encode() for i, t, _ in rows}
    for r in phrases.collocations(table(spark, rows), 20).collect():
        found = texts[r["doc_id"]][r["at"] :].decode()
        assert re.split(r"[\x20\x09]+", found)[: r["phrase"].count(" ") + 1][0] == r["phrase"].split(" ")[0]
        assert re.match(r"[\x20\x09]+".join(map(re.escape, r["phrase"].split(" "))), found)


@pytest.mark.parametrize("stretch", [1, 3, 7, 64, 1 << 20])
def test_words_do_not_depend_on_stretches(stretch):
    text = "Ab  cd.\tef gh\n\n  ij,kl lm  verylongword " + "z" * 50 + " été 中\n"
    data, starts, _, _ = phrases.joined([("en", text.encode(), 1), (None, b"", 2), ("de", b"Ab q", 3)])
    one, cut = phrases.Words(data, starts), phrases.Words(data, starts, stretch)
    for name in ("at", "length", "hash", "piece", "text"):
        assert np.array_equal(getattr(one, name), getattr(cut, name)), name
    whole = bytes(data)
    assert [one.bytes_of(i, 1) for i in range(len(one.at))] == [w for w in re.findall(rb"[^\x20\x09.,;:!?\x0a-\x0d]+", whole)]
    assert one.hash[0] == one.hash[-2] and len(set(one.hash.tolist())) == len(set(one.bytes_of(i, 1) for i in range(len(one.at))))


def test_collisions_are_told_apart():
    data, starts, langs, _ = phrases.joined([("en", b"a b a c a b", 1), ("de", b"a b", 2)])
    words = phrases.Words(data, starts)
    words.hash[:] = np.uint64(7)  # every word collides
    names = phrases.word_names(words)
    assert names.tolist() == [0, 1, 0, 2, 0, 1, 0, 1]
    code = np.array([0, 1])
    first, count = phrases.grouped(words, names, code, np.array([0, 2, 4, 6]), np.zeros(4, np.uint64), 2)
    assert sorted((langs[words.text[i]], words.bytes_of(i, 2), int(k)) for i, k in zip(first, count, strict=True)) == [("de", b"a b", 1), ("en", b"a b", 2), ("en", b"a c", 1)]


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], DDL)).count() == 0
