"""Phrases whose words stand together more often than chance, found by Rabin-Karp fingerprints."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.llm.common import settle

U = np.uint64
LONGEST = 5
UNKNOWN = "und"
# What a byte is: part of a word, a blank between words, the end of a piece.
WORD, BLANK, BREAK = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[9, 32]] = BLANK
KIND[[10, 11, 12, 13, *b".,;:!?"]] = BREAK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit number over all its bits; one-to-one."""
    h = (h ^ (h >> U(31))) * U(0x7FB5D329728EA185)
    h = (h ^ (h >> U(27))) * U(0x81DADEF4BC2DD44D)
    return h ^ (h >> U(33))


LETTER = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
WORD_BASE = U(0xC2B2AE3D27D4EB4F)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of consecutive texts as arrays: place of the first byte, length, fingerprint, piece and text.

    ``data`` is read some bytes at a time. A prefix polynomial over the letters of a stretch gives the fingerprint of
    every word in it by two look-ups; a word cut by the end of a stretch is carried over with the fingerprint of its
    first part, so words of any length are whole and the memory besides ``data`` is a stretch's and some numbers a word.
    ``kinds`` tells what each byte is.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, stretch: int = 1 << 20, kinds: np.ndarray = KIND):
        self.data, parts, breaks = data, [], 0
        forward, back = _powers(BASE, stretch + 1), _powers(UNBASE, stretch + 1)
        head, head_hash, head_len = -1, U(0), 0
        for lo in range(0, len(data), stretch):
            part = data[lo : lo + stretch]
            kind = kinds[part]
            inside = kind == WORD
            edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
            begin, end = edge[::2], edge[1::2]
            prefix = np.zeros(len(part) + 1, U)
            np.cumsum(LETTER[part] * back[: len(part)], out=prefix[1:])
            # sum of letter * UNBASE ** (place in the word)
            value = (prefix[end] - prefix[begin]) * forward[begin]
            length, at = (end - begin).astype(np.int64), begin.astype(np.int64) + lo
            piece = breaks + np.cumsum(kind == BREAK)[begin] if len(begin) else np.zeros(0, np.int64)
            breaks += int((kind == BREAK).sum())
            if head >= 0 and not inside[0]:
                parts.append((np.array([head]), np.array([head_len]), np.array([head_hash], U), np.array([head_piece])))
                head = -1
            elif head >= 0:
                value[:1] = value[:1] * U(pow(UNBASE, head_len, 1 << 64)) + head_hash
                length[0] += head_len
                at[0], piece[0], head = head, head_piece, -1
            if inside[-1] and lo + stretch < len(data):
                head, head_len, head_hash, head_piece = int(at[-1]), int(length[-1]), value[-1], int(piece[-1])
                at, length, value, piece = at[:-1], length[:-1], value[:-1], piece[:-1]
            parts.append((at, length, value, piece))
        self.at, self.length, value, self.piece = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 4
        self.hash = mix(value.astype(U) + self.length.astype(U) * U(0xA0761D6478BD642F))
        self.text = np.searchsorted(starts, self.at, "right") - 1

    def bytes_of(self, i: int, n: int) -> bytes:
        return b" ".join(self.data[self.at[k] : self.at[k] + self.length[k]].tobytes() for k in range(i, i + n))


class Fingerprints:
    """How phrases become 64-bit numbers; tests take few ``bits`` to make them collide."""

    def __init__(self, bits: int = 64):
        self.drop = U(64 - bits)

    def of(self, words: Words, seeds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, fingerprints) of all phrases of n words; the seed tells languages apart."""
        m = max(len(words.at) - n + 1, 0)
        first = np.flatnonzero(words.piece[:m] == words.piece[n - 1 : n - 1 + m])
        h = seeds[first]
        for k in range(n):
            h = h * WORD_BASE + words.hash[first + k]
        return first, mix(h + U(n)) >> self.drop


class Bitmap:
    """Set of fingerprints in a table of 2 ** bits bits: what it lacks is not in the set."""

    def __init__(self, table: np.ndarray):
        self.table, self.mask = table, U(len(table) * 64 - 1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        slot = mix(h) & self.mask
        return (self.table[(slot >> U(6)).astype(np.int64)] >> (slot & U(63)) & U(1)).astype(bool)


def bitmap_of(prints: DataFrame, bits: int) -> Bitmap:
    """A `Bitmap` of the column ``print``; at most 2 ** bits / 64 numbers reach the driver, however many rows there are."""
    words = 1 << bits - 6

    def slots(batches):
        for b in batches:
            slot = mix(b.column(0).to_numpy(zero_copy_only=False).view(U)) & U((words << 6) - 1)
            yield pa.RecordBatch.from_arrays([pa.array((slot >> U(6)).view(np.int64)), pa.array((U(1) << (slot & U(63))).view(np.int64))], ["word", "bit"])

    rows = prints.select("print").mapInArrow(slots, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(words, U)
    table[rows.column("word").to_numpy()] = rows.column("bit").to_numpy().view(U)
    return Bitmap(table)


def texts_of(batches, step: int):
    """(joined lower-case bytes, starts, languages, ids) of some megabytes of text at a time; texts are never cut."""
    part, size = [], 0
    for b in batches:
        for lang, text, doc in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), b.column("doc_id").to_pylist(), strict=True):
            raw = (text or "").encode()
            part.append((lang, raw, doc))
            size += len(raw) + 1
            if size >= step:
                yield joined(part)
                part, size = [], 0
    if part:
        yield joined(part)


def joined(part):
    langs, texts, docs = zip(*part, strict=True)
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    starts = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    return data, starts, [UNKNOWN if x is None else x for x in langs], docs


def seeds_of(langs: list[str], words: Words) -> np.ndarray:
    by = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
    return np.array([by[x] for x in langs], U)[words.text]


def likely(words: Words, seeds: np.ndarray, prints: Fingerprints, frequent: Bitmap | None, n: int):
    """(first words, fingerprints) of the phrases of n words of which every part the bitmap was asked for may be frequent.

    Longer phrases are frequent only if all their words, and all their pairs of words, are.
    """
    first, h = prints.of(words, seeds, n)
    if frequent is None or n == 1:
        return first, h
    size = 1 if n == 2 else 2
    at, part = prints.of(words, seeds, size)
    good = np.zeros(len(words.at) + 1, bool)
    good[at[frequent(part)]] = True
    whole = reduce(np.logical_and, [good[first + k] for k in range(n - size + 1)])
    return first[whole], h[whole]


def gathered(docs: DataFrame, splits: int = 4) -> DataFrame:
    """``docs`` with up to ``splits`` neighbouring splits a task, so that more is added up before it moves."""
    n = docs.rdd.getNumPartitions()
    return docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-n // splits)))


def count_prints(docs: DataFrame, sizes: list[int], frequent: Bitmap | None, least: int, prints: Fingerprints, step: int) -> DataFrame:
    """(print) of phrases of these sizes that may occur ``least`` times; counted a batch, then a task, then over all tasks."""

    def run(batches):
        for data, starts, langs, _ in texts_of(batches, step):
            words = Words(data, starts)
            seeds = seeds_of(langs, words)
            for n in sizes:
                h, count = np.unique(likely(words, seeds, prints, frequent, n)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(count.astype(np.int64))], ["print", "n"])

    counted = gathered(docs).mapInArrow(run, "print long, n long")
    return counted.groupBy("print").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("print")


def same_words(words: Words, i: np.ndarray, j: np.ndarray, step: int = 1 << 20) -> bool:
    """Whether each word i has the bytes of word j, compared byte by byte."""
    differ = i != j
    i, j = i[differ], j[differ]
    if (words.length[i] != words.length[j]).any():
        return False
    ends = np.cumsum(words.length[i])
    lo = 0
    while lo < len(i):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + step)))
        length = words.length[i[lo:hi]]
        if hi == lo + 1:
            a, b, n = int(words.at[i[lo]]), int(words.at[j[lo]]), int(length[0])
            equal = all((words.data[a + k : a + min(k + step, n)] == words.data[b + k : b + min(k + step, n)]).all() for k in range(0, n, step))
        else:
            inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            equal = (words.data[np.repeat(words.at[i[lo:hi]], length) + inner] == words.data[np.repeat(words.at[j[lo:hi]], length) + inner]).all()
        if not equal:
            return False
        lo = hi
    return True


def word_names(words: Words) -> np.ndarray:
    """A number for each word, the same for equal bytes only: fingerprints held against the text."""
    _, first, name = np.unique(words.hash, return_index=True, return_inverse=True)
    if same_words(words, np.arange(len(words.at)), first[name]):
        return name
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(words.bytes_of(i, 1), len(seen)) for i in range(len(words.at))], np.int64)


def grouped(words: Words, names: np.ndarray, langs: np.ndarray, first: np.ndarray, h: np.ndarray, n: int):
    """(first word, occurrences) of each distinct phrase among those that begin at ``first``.

    Equal fingerprints are held against the words; if one stands for two phrases, all are told apart by their words.
    """
    _, rep, group, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    rep = first[rep]
    same = langs[words.text[rep[group]]] == langs[words.text[first]]
    for k in range(n):
        same &= names[rep[group] + k] == names[first + k]
    if same.all():
        return rep, count
    keys = np.stack([langs[words.text[first]], *[names[first + k] for k in range(n)]], axis=1)
    _, rep, count = np.unique(keys, axis=0, return_index=True, return_counts=True)
    return first[rep], count


def read_phrases(docs: DataFrame, frequent: Bitmap, prints: Fingerprints, step: int, held: int = 300_000) -> DataFrame:
    """(lang, phrase, n, doc_id, at) of the phrases with a frequent fingerprint, from the text; '' counts all words.

    ``doc_id`` and ``at`` (the byte in the lower-case text) point at an occurrence. A task adds up its phrases before
    it sends them, and sends what it holds when that passes ``held`` phrases.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        table: dict[tuple[str, bytes], list] = {}
        for data, starts, langs, docs_ in texts_of(batches, step):
            words = Words(data, starts)
            seeds, names = seeds_of(langs, words), word_names(words)
            kinds, code = np.unique(np.array(langs, object), return_inverse=True)
            for c, k in enumerate(np.bincount(code[words.text], minlength=len(kinds)).tolist()):
                table.setdefault((kinds[c], b""), [0, None, None])[0] += k
            for n in range(1, LONGEST + 1):
                first, h = likely(words, seeds, prints, frequent, n)
                known = frequent(h)
                for i, k in zip(*[x.tolist() for x in grouped(words, names, code, first[known], h[known], n)], strict=True):
                    t = words.text[i]
                    entry = table.setdefault((langs[t], words.bytes_of(i, n)), [0, docs_[t], int(words.at[i] - starts[t])])
                    entry[0] += k
            if len(table) >= held:
                yield rows_of(table)
                table.clear()
        yield rows_of(table)

    def rows_of(table):
        from pyspark.sql.pandas.types import to_arrow_type

        n, doc, at = zip(*table.values(), strict=True) if table else ((), (), ())
        cols = [pa.array([k[0] for k in table], pa.string()), pa.array([k[1].decode() for k in table], pa.string()), pa.array(n, pa.int64()), pa.array(doc, to_arrow_type(doc_type)), pa.array(at, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["lang", "phrase", "n", "doc_id", "at"])

    doc_type = docs.schema["doc_id"].dataType
    found = gathered(docs).mapInArrow(run, f"lang string, phrase string, n long, doc_id {kind}, at long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"), F.min("doc_id").alias("doc_id"), F.min_by("at", "doc_id").alias("at"))


def frequent_phrases(docs: DataFrame, least: int = 100, filter_bits: int = 26, hash_bits: int = 64, step: int = 8 << 20) -> DataFrame:
    """(lang, phrase, n, doc_id, at): every phrase of 1 to 5 words that occurs ``least`` times in its language, and '' for all words.

    Three passes count fingerprints: words, pairs of frequent words, then phrases of 3 to 5 words with frequent pairs.
    What is frequent goes from pass to pass as a bit table of fixed size (``filter_bits``), which can only let through
    too much. A last pass counts the phrases themselves for the fingerprints that are left, so results are exact
    whatever collides. The candidates' shuffle carries 16 bytes a fingerprint and batch; pointers to occurrences
    travel with the phrases of the last pass, of which there are few.
    """
    prints = Fingerprints(hash_bits)
    docs = docs.select("lang", "text", "doc_id")
    found, bitmap = None, None
    for sizes in ([1], [2], list(range(3, LONGEST + 1))):
        new = settle(count_prints(docs, sizes, bitmap, least, prints, step))
        found = new if found is None else found.union(new)
        bitmap = bitmap_of(found, filter_bits)
    return read_phrases(docs, bitmap, prints, step).filter((F.col("n") >= least) | (F.col("phrase") == ""))


def collocations(docs: DataFrame, least: int = 100, subsumed_percent: int = 100, top: int | None = None, **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, doc_id, at) of phrases of 2 to 5 words.

    ``docs`` has doc_id, lang and text. A-Z count as lower case; ``[.,;:!?\\n-\\r]`` end pieces, blanks and tabs words.
    a, l and r are the occurrences of the phrase and of its two parts at the cut with the least
    score = floor(1000 * a * n / (l * r)), ties to the earliest cut; n is all words of the language. A phrase goes if a
    longer candidate around it has ``subsumed_percent`` of its occurrences. ``top`` keeps the best of each language
    (score, then a, both descending, then the phrase in byte order).

    Null texts have no words, a null lang is ``und``, repeated rows count each, further columns are ignored. Numbers
    are decimals of 38 digits, exact up to 10 ** 16 words a language. Texts of any length are read whole.
    """
    known = settle(frequent_phrases(docs, least, **how))
    words = F.split("phrase", " ", -1)
    longer = known.filter("phrase != ''").withColumn("words", words).withColumn("size", F.size("words")).filter("size > 1")
    piece = lambda c, i, n: F.array_join(F.slice(c, i, n), " ")
    cuts = longer.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "n", "doc_id", "at", "k", piece("words", F.lit(1), F.col("k")).alias("left"), piece("words", F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    part = lambda name, n: known.select(F.col("lang").alias("lang"), F.col("phrase").alias(name), F.col("n").alias(n))
    total = known.filter("phrase = ''").select(F.col("lang"), F.col("n").alias("total"))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(total, "lang")
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    scored = cuts.withColumn("over", wide("n") * F.lit(1000).cast("decimal(4,0)") * wide("total")).withColumn("under", wide("l") * wide("r")).withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", F.col("n").alias("a"), "l", "r", F.col("total").alias("n"), "doc_id", "at")).alias("b")
    ).select("lang", "phrase", "b.*")
    starts = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("i")
    spans = longer.filter("size > 2").select("lang", "n", "words", "size", starts).select("lang", "n", "words", "size", "i", F.explode(F.sequence(F.lit(2), F.least(F.col("size") - 1, F.col("size") - F.col("i") + 1))).alias("m"))
    around = spans.select("lang", piece("words", F.col("i"), F.col("m")).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("around"))
    out = best.join(around, ["lang", "phrase"], "left").filter(F.col("around").isNull() | (wide("around") * 100 < wide("a") * subsumed_percent))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = out.withColumn("rank", rank)
    if top is not None:
        out = out.filter(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "doc_id", "at")
