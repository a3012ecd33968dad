"""Counting word pieces: greedy longest match along a trie, with a vocabulary of the user's."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.errors import EvidenceError
from evispark.functions import text as T
from evispark.operators.ranking import exact_percentiles, linear, lower_index

MOST_PIECES = 500_000
# Longer words are one unknown piece; the pieces of so many words are kept by each task.
LONGEST_WORD, KEPT_WORDS = 100, 200_000
CONTINUED = "##"
# Rows whose words are Python objects at one time: a batch of 10,000 passages has millions of words.
ROWS_AT_ONCE = 64


class Trie:
    """Pieces as nested dicts by letter; ``END`` marks where one ends."""

    END = ""

    def __init__(self, pieces):
        self.first, self.later = {}, {}
        for p in pieces:
            node = self.later if p.startswith(CONTINUED) and len(p) > len(CONTINUED) else self.first
            for c in p.removeprefix(CONTINUED) if node is self.later else p:
                node = node.setdefault(c, {})
            node[self.END] = True

    def cut(self, word: str) -> list[str] | None:
        """Pieces of a word, each the longest that fits, or None where none does."""
        out, at = [], 0
        if len(word) > LONGEST_WORD:
            return None
        while at < len(word):
            node, end = self.later if at else self.first, 0
            for i in range(at, len(word)):
                node = node.get(word[i])
                if node is None:
                    break
                if self.END in node:
                    end = i + 1
            if not end:
                return None
            out.append((CONTINUED if at else "") + word[at:end])
            at = end
        return out


def collected(vocabulary: DataFrame) -> list[str]:
    """The column ``piece`` on the driver, which a vocabulary of more than ``MOST_PIECES`` is refused."""
    rows = [r[0] for r in vocabulary.select("piece").filter("piece <> ''").distinct().limit(MOST_PIECES + 1).collect()]
    if len(rows) > MOST_PIECES:
        raise EvidenceError(f"vocabulary of more than {MOST_PIECES} pieces")
    return rows


def piece_counts(docs: DataFrame, vocabulary: DataFrame, words: Column | None = None, keep=("doc_id",)) -> DataFrame:
    """(keep, n_words, n_pieces, n_unknown) for each row of ``docs``: pieces as an encoder counts them, nothing truncated, no special ones.

    ``words`` is an array of the words of a text, by default those of `functions.text.tokens`; an unknown word is one
    piece. ``vocabulary`` has the column ``piece``, continuations beginning with ``##``. One pass, no shuffle; each task
    remembers a bounded number of words. A null text has no words.
    """
    keep = list(keep)
    shared = docs.sparkSession.sparkContext.broadcast(collected(vocabulary))  # at most MOST_PIECES
    rows = docs.select(*keep, (T.tokens(F.col("text")) if words is None else words).alias("_words"))
    schema = rows.drop("_words").schema.add("n_words", "long").add("n_pieces", "long").add("n_unknown", "long")

    def run(batches):
        trie, known = Trie(shared.value), {}

        def size(word):
            n = known.get(word)
            if n is None:
                n = len(trie.cut(word) or ())
                if len(known) < KEPT_WORDS and len(word) <= LONGEST_WORD:
                    known[word] = n
            return n

        for b in batches:
            out = []
            words = b.column("_words")
            for at in range(0, len(words), ROWS_AT_ONCE):
                for ws in words.slice(at, ROWS_AT_ONCE).to_pylist():
                    sizes = [size(w) for w in ws or ()]
                    out.append((len(sizes), sum(sizes) + sizes.count(0), sizes.count(0)))
            n, pieces, unknown = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], *[pa.array(x, pa.int64()) for x in (n, pieces, unknown)]], [*keep, "n_words", "n_pieces", "n_unknown"])

    return rows.mapInArrow(run, schema)


def truncation_statistics(counts: DataFrame, keys, size: str = "n_pieces", window: int = 256) -> DataFrame:
    """How texts of ``size`` pieces fare in a window: mean, median, extremes, p90, share cut, mean and median share retained.

    p90 is the value at int(0.9 * (n - 1)) of the sorted ones; an empty text is retained whole.
    """
    keys = list(keys)
    kept = F.when(F.col(size) > window, F.lit(float(window)) / F.col(size)).otherwise(F.lit(1.0))
    rows = counts.withColumn("_kept", kept)
    plain = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(size).alias("mean_pieces"), F.max(size).alias("largest"), F.min(size).alias("smallest"),
        F.avg((F.col(size) > window).cast("double")).alias("truncated_share"), F.avg("_kept").alias("mean_retained"),
    )
    sizes = exact_percentiles(rows, keys, size, {"median_pieces": linear(0.5), "p90_pieces": lower_index(0.9)})
    shares = exact_percentiles(rows, keys, "_kept", {"median_retained": linear(0.5)})
    return plain.join(sizes, keys).join(shares, keys)
