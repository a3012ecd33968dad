"""Byte-level BPE by prefix-sharing traversal of a trie of distinct words."""

from __future__ import annotations

import functools
import itertools
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.common import KEPT_CHARS

UNIT = r"\s*\S+|\s+"
# Fixed value: the word pattern of this family of vocabularies.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Blank to Python's str methods, but not to the word pattern.
ODD_BLANKS = "\x1c\x1d\x1e\x1f"


def byte_letters() -> dict[str, int]:
    """The vocabulary's printable letter of each byte: itself where printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Known(dict):
    """Encodings of units that are kept for good, and behind them those of the batch at hand."""

    def __init__(self):
        super().__init__()
        self.batch: dict[str, bytes] = {}

    def __missing__(self, unit: str) -> bytes:
        return self.batch[unit]


class TrieEncoder:
    """BPE of words from states on trie nodes.

    The state of a node is the last token of the encoding of the bytes on the
    path to it. BPE encodings have this property: cut at any token, the front
    part is the encoding of its bytes; and a token sequence is an encoding if
    and only if each neighbouring pair is one. So exactly one token that ends
    at the node fits behind the state found |token| bytes above, and a word is
    read off by walking up from its node. A prefix that many words share is
    worked out once. Whether a pair holds together is asked of the merge table
    once and remembered.
    """

    def __init__(self, path: str, memory: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.bytes_of: dict[int, bytes] = {}
        for token, i in spec["model"]["vocab"].items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        special_ids = set(self.special.values())
        self.id_of = {b: i for i, b in self.bytes_of.items() if i not in special_ids}
        self.merge: dict[tuple[bytes, bytes], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge.setdefault((bytes(letters[c] for c in a), bytes(letters[c] for c in b)), rank)
        self.longest = max(map(len, self.id_of))
        # A token that merging its own bytes does not give can end no encoding.
        self.whole: dict[bytes, bool] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.memory, self.known = memory, Known()
        table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.lengths = np.array([len(b) for b in table])
        self.table = table

    def by_merging(self, data: bytes) -> list[bytes]:
        """Plain BPE of a few bytes; only tokens and pairs of tokens are ever asked for."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.merge.get((parts[i], parts[i + 1]), 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def is_whole(self, token: bytes) -> bool:
        ok = self.whole.get(token)
        if ok is None:
            ok = self.whole[token] = self.by_merging(token) == [token]
        return ok

    def holds(self, left: bytes, right: bytes) -> bool:
        ok = self.pairs.get((left, right))
        if ok is None:
            if len(self.pairs) >= 500_000:
                self.pairs.clear()
            ok = self.pairs[left, right] = self.by_merging(left + right) == [left, right]
        return ok

    def encode_words(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Little-endian ids of distinct words.

        The trie is laid out in depth-first order: in sorted words, the nodes
        that a word shares with the words before it are the first bytes it has
        in common with its predecessor, and the states on the current path are
        all that has to be kept.
        """
        out: dict[bytes, bytes] = {}
        id_of, longest = self.id_of, self.longest
        path = b""
        state: list[bytes] = [b""]  # state[d]: last token of the first d bytes
        for word in sorted(words):
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del state[shared + 1 :]
            for d in range(shared + 1, len(word) + 1):
                for start in range(max(0, d - longest), d):
                    token = word[start:d]
                    if token in id_of and self.is_whole(token) and (not start or self.holds(state[start], token)):
                        state.append(token)
                        break
                else:
                    raise ValueError("the vocabulary has no token for a byte")
            ids, d = [], len(word)
            while d:
                ids.append(id_of[state[d]])
                d -= len(state[d])
            ids.reverse()
            out[word] = np.array(ids, dtype="<u4").tobytes()
            path = word
        return out

    @functools.cached_property
    def _patterns(self):
        import re

        import regex

        special = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        return re.compile(UNIT).findall, regex.compile(WORD).findall, (re.compile(f"({special})").split if special else lambda x: [x])

    def units(self, text: str) -> list[str]:
        """Blanks and the word behind them: no token reaches over the end of a word, so these are encoded apart."""
        if any(c in text for c in ODD_BLANKS):
            return [text]
        return self._patterns[0](text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        _, words_of, split = self._patterns
        cut = [self.units(t) for t in texts]
        known = self.known
        new: dict[str, list] = {}
        for units in cut:
            for u in units:
                if u not in known and u not in new:
                    parts = [] if not any(s in u for s in self.special) else split(u)
                    if parts:
                        new[u] = [self.special[p] if p in self.special else w for p in parts for w in ([p] if p in self.special else [x.encode() for x in words_of(p)])]
                    else:
                        new[u] = [x.encode() for x in words_of(u)]
        ids = self.encode_words({w for ws in new.values() for w in ws if isinstance(w, bytes)})
        known.batch = {u: b"".join([ids[w] if isinstance(w, bytes) else np.array([w], dtype="<u4").tobytes() for w in ws]) for u, ws in new.items()}
        room = self.memory - len(known)
        if room > 0:  # words met early are the common ones; no word is put out again
            known.update(itertools.islice(((u, x) for u, x in known.batch.items() if len(u) <= KEPT_CHARS), room))
        get = known.__getitem__
        return [b"".join(map(get, units)) for units in cut]

    def decode(self, ids: bytes) -> str:
        """Text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)



def encode_table(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", step_chars: int = 4 << 20) -> DataFrame:
    """(doc_id, ids binary, decoded string) for each row, in one pass without a shuffle.

    Each task inserts the distinct words of some megabytes of text into a trie
    and keeps the encodings of a bounded number of words; nothing depends on
    other tasks, so a lost executor costs its tasks alone. A null text is the
    empty one and has no ids; a null id stays null; repeated rows repeat.
    """

    def run(batches):
        import pandas as pd

        enc = encoder(vocab)
        for pdf in batches:
            texts = ["" if x is None else x for x in pdf["text"]]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (size < step_chars or end == at):
                    size += len(texts[end])
                    end += 1
                ids = enc.encode(texts[at:end])
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[at:end].astype("Int64").to_numpy(), "ids": ids, "decoded": [enc.decode(i) for i in ids]})
                at = end

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, vocab: str) -> DataFrame:
    """Digest columns of `encode_table`."""
    return encode_table(docs, vocab).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
