"""What several of the operators share: reading, settling, global positions, batched encoding, hashing of words."""

from __future__ import annotations

import functools
import itertools
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.session import ensure_checkpoint_dir, settle

__all__ = ["crc32_join", "encode_texts", "load", "prefix_sums", "scratch_path", "settle", "vocabulary"]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder of the session."""
    import uuid

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def vocabulary(name: str) -> str:
    """Default place of a public tokenizer's file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def prefix_sums(df: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """``df`` in the global order of ``order`` with exclusive running sums.

    ``sums`` maps new columns to the long columns they add up. Rows are dealt
    by ranges of ``order`` (so ``order`` should tell rows apart), written once,
    summed within each range in one streaming pass, and shifted by the sums of
    the ranges before, of which there is one row a partition.
    """
    at = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = at.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    shifts = totals.select("_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(n) for n in sums])
    schema = at.drop("_range").schema
    for n in sums:
        schema = schema.add(n, "long")
    names, cols = list(sums), list(sums.values())

    def run(batches):
        import pandas as pd

        carry = dict.fromkeys(names, 0)
        for pdf in batches:
            out = pdf.drop(columns=["_range"])
            for n, c in zip(names, cols, strict=True):
                v = pdf[c].to_numpy(dtype=np.int64)
                incl = np.cumsum(v) + carry[n]
                out[n] = pd.Series(incl - v + pdf[n].to_numpy(dtype=np.int64), index=pdf.index)
                if len(incl):
                    carry[n] = int(incl[-1])
            yield out

    return at.join(F.broadcast(shifts), "_range").mapInPandas(run, schema)


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizers library with the vocabulary at ``path``; one thread, as Spark runs one task a core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, or where ``df`` has a column of that name, the name with as many underscores behind it as it takes."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


# Longer units between blanks are not kept from batch to batch, so a number of units bounds the bytes that are kept.
KEPT_CHARS = 64

# Texts of so many times as many characters are taken at a time where they are cut in units.
UNITS_STEP = 2

# ASCII marks that a word may stand between. No apostrophe, which may begin a contraction, and none of "<>" of special tokens.
MARKS = '!"#$%&()*+,-./:;=?@[\\]^_`{|}~'

# The one letter whose lower case is a letter and a mark.
FALLS_APART = "\u0130"


class UnitEncoder:
    """The tokenizers library for vocabularies that drop blanks, asked once for each distinct word between blanks.

    A unit between blanks that is marks, letters, marks is asked for in these three parts, as the library cuts it there.
    ``ends`` says which ids end a word. Encodings of the first ``memory`` words of at most ``KEPT_CHARS`` characters
    are kept for good, those of others for the batch at hand, so memory is bounded.
    """

    def __init__(self, path: str, ends: np.ndarray, memory: int = 400_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.memory, self.known, self.ends = tokenizer(path), memory, {"": b""}, ends
        # the same model for words of a to z, which no normalising changes and nothing cuts
        self.plain = Tokenizer(self.library.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    def ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def ask_words(self, words: list[str], plain: bool = False, at_once: int = 500) -> list[bytes]:
        """As `ask` for short words of letters only: many a text, which ids that end a word tell apart again."""
        library = self.plain if plain else self.library
        groups = [words[i : i + at_once] for i in range(0, len(words), at_once)]
        out = []
        for group, e in zip(groups, library.encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(group):
                raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
                out += [raw[x:y] for x, y in itertools.pairwise(cuts)]
            else:  # a word that the library cuts in more parts
                out += self.ask(group)
        return out

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        known = self.known
        out = list(map(known.get, pieces))
        plain, words, others = [], [], []
        for i, ids in enumerate(out):
            if ids is None:
                x = pieces[i]
                letters = len(x) <= KEPT_CHARS and x.isalpha() and FALLS_APART not in x
                (plain if letters and x.isascii() and x.islower() else words if letters else others).append(i)
        for at, ask in ((plain, lambda w: self.ask_words(w, plain=True)), (words, self.ask_words), (others, self.ask)):
            asked = [pieces[i] for i in at]
            fresh = ask(asked)
            for i, ids in zip(at, fresh, strict=True):
                out[i] = ids
            known.update(itertools.islice(((x, ids) for x, ids in zip(asked, fresh, strict=True) if len(x) <= KEPT_CHARS), max(self.memory - len(known), 0)))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        # At ASCII blanks only: others stay inside a unit, where the library drops them.
        cut = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        counts, coded = cut.value_lengths().to_numpy(), cut.flatten().dictionary_encode()
        del cut
        units, which = coded.dictionary, coded.indices.to_numpy()
        core = pc.ascii_lower(pc.ascii_trim(units, characters=MARKS))
        word = pc.and_(pc.utf8_is_alpha(core), pc.invert(pc.match_substring(core, FALLS_APART)))
        keys = pc.if_else(word, core, units).dictionary_encode()
        pieces, marks = keys.dictionary.to_numpy(zero_copy_only=False).tolist(), {"": 0}
        parts = np.full((len(units), 3), len(pieces), np.int32)
        parts[:, 1] = keys.indices.to_numpy()
        for column, trim in ((0, pc.ascii_ltrim), (2, pc.ascii_rtrim)):
            size = pc.subtract(pc.binary_length(units), pc.binary_length(trim(units, characters=MARKS))).to_numpy()
            at = np.flatnonzero((size > 0) & word.to_numpy(zero_copy_only=False))
            found = zip(units.take(pa.array(at)).to_numpy(zero_copy_only=False), size[at].tolist(), strict=True)
            parts[at, column] = [len(pieces) + marks.setdefault(u[-k:] if column else u[:k], len(marks)) for u, k in found]
        ids = self.pieces(pieces + list(marks))
        flat, ends = gathered(np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4, parts.ravel())
        flat, ends = gathered(flat, np.diff(ends[::3]), which)
        bounds = ends[np.cumsum(counts)]
        del coded, units, which, core, word, keys
        pa.default_memory_pool().release_unused()
        return [flat[x:y] for x, y in itertools.pairwise([0, *bounds.tolist()])]


def gathered(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ``flat``, given by their sizes, in the order of ``which``, and where each begins and the last ends."""
    size = sizes[which]
    ends = np.concatenate([[0], np.cumsum(size)])
    kind = np.int32 if max(len(flat), ends[-1]) < 1 << 31 else np.int64
    at = np.repeat(((np.cumsum(sizes) - sizes)[which] - ends[:-1]).astype(kind), size)
    at += np.arange(len(at), dtype=kind)
    return flat[at], ends


@functools.lru_cache(maxsize=2)
def unit_encoder(path: str) -> UnitEncoder | None:
    """A `UnitEncoder` where blanks end words and give no ids, else None."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    parts = (spec["normalizer"] or {}).get("normalizers", [])
    first = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    blanks = [n["type"] for n in parts] == ["NFC", "Replace", "Lowercase"] and parts[1]["pattern"] == {"Regex": r"\s+"}
    drops = first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and r"[^\s\p{L}\p{N}]+" in first["pattern"]["Regex"]
    words = drops and r"|[\p{L}]+|" in first["pattern"]["Regex"] and [(p["type"], p.get("add_prefix_space")) for p in spec["pre_tokenizer"]["pretokenizers"][1:]] == [("ByteLevel", False)]
    whole = not any(t["content"].strip(MARKS).isalpha() or len(t["content"].split()) != 1 for t in spec["added_tokens"])
    suffix = spec["model"].get("end_of_word_suffix")
    if not (blanks and words and whole and suffix):
        return None
    ends = np.zeros(max(spec["model"]["vocab"].values()) + len(spec["added_tokens"]) + 1, bool)
    ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
    return UnitEncoder(path, ends)


def encode_texts(texts, path: str, step_chars: int = 4 << 20):
    """Ids of each text as uint32 arrays, as the tokenizers library gives them, some megabytes of text at a time."""
    fast = fast_encoder(path)
    if fast:
        for x in texts:
            yield fast(x or "").astype("<u4")
        return
    units = unit_encoder(path)
    t = tokenizer(path)
    step = UNITS_STEP * step_chars if units else step_chars
    part, size = [], 0

    def flush():
        if units:
            yield from units.encode(part)
            return
        for e in t.encode_batch_fast(part, add_special_tokens=False):
            yield np.array(e.ids, dtype="<u4")

    for x in texts:
        part.append(x or "")
        size += len(part[-1])
        if size >= step:
            yield from flush()
            part, size = [], 0
    if part:
        yield from flush()


# From so many blanks in a row on, the faster encoder's pattern runs out of stack; such texts go to the library.
BLANK_RUN = 2000


def ranks_say_merges(ranks: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> bool:
    """Whether merging the pair with the lowest rank first is the same as merging in the order of ``merges``.

    It is, if the tokens of the merges have rising ranks and each token's bytes, merged with the tokens of lower rank
    only, end up as just the two parts its merge has: then no other pair can ever become that token.
    """
    order = [ranks.get(a + b, -1) for a, b in merges]
    if order != sorted(set(order)) or order[:1] == [-1]:
        return False
    for (a, b), top in zip(merges, order, strict=True):
        parts = [bytes([x]) for x in a + b]
        while len(parts) > 2:
            found = [(ranks.get(x + y, top), i) for i, (x, y) in enumerate(itertools.pairwise(parts))]
            rank, i = min(found)
            if rank >= top:
                return False
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if parts != [a, b]:
            return False
    return True


@functools.lru_cache(maxsize=2)
def fast_encoder(path: str):
    """A function from text to ids for a byte-level vocabulary of the tokenizers library, or None.

    Where the words are cut by the usual pattern and `ranks_say_merges` holds
    for the whole table, which is checked here, tiktoken gives the same ids
    several times faster. Texts with ``BLANK_RUN`` blanks in a row, which it
    cannot read, go to the library, in stretches that give the same ids.
    """
    import json
    import re

    import public_tokenizers
    import tiktoken

    from evispark.llm.bpe import byte_letters
    from evispark.llm.tokencount import cuts, cuts_at_blanks

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"] and not model.get("end_of_word_suffix")
    if not plain:
        return None
    letters = byte_letters()
    raw = lambda token: bytes(letters[c] for c in token)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {raw(t): i for t, i in model["vocab"].items() if t not in special}
    merges = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if not ranks_say_merges(ranks, merges):
        return None
    enc = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    library, blanks, safe = tokenizer(path), re.compile(rf"\s{{{BLANK_RUN}}}"), cuts_at_blanks(path)

    def encode(text: str) -> np.ndarray:
        if len(text) >= BLANK_RUN and blanks.search(text):
            parts = cuts(text, 1 << 20) if safe else [text]
            return np.concatenate([np.array(library.encode(x, add_special_tokens=False).ids, np.uint32) for x in parts])
        return enc.encode_to_numpy(text, allowed_special="all", disallowed_special=())

    return encode


def _crc_shift_table(n: int) -> list[int]:
    """How each of the 32 bits of a crc32 moves when n zero bytes follow."""
    import zlib

    zero = zlib.crc32(bytes(n))
    # crc32(zeros after state s) is affine in s; zlib takes the state as its start value.
    return [zlib.crc32(bytes(n), 1 << b) ^ zero for b in range(32)]


def crc32_join(parts) -> int:
    """crc32 of a whole from (crc32, length in bytes) of its consecutive parts."""
    out = 0
    for crc, n in parts:
        if n:
            moved, table = 0, _crc_shift_table(n)
            for b in range(32):
                if out >> b & 1:
                    moved ^= table[b]
            out = moved ^ crc
    return out
