"""Token counts of texts through a cache of digests: only texts that were never counted are encoded."""

from __future__ import annotations

import hashlib
import importlib.metadata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from evispark.llm.common import settle, tokenizer
from evispark.session import BROADCAST_BYTES

ROW_BYTES = 64  # a digest in a broadcast table, generously
CACHE = "version string, digest binary, n_tokens long"


def version_of(path: str) -> str:
    """Digest of a tokenizer: its file, and the library and release that read it."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    h = hashlib.sha256(f"{library} {importlib.metadata.version(library)}\n".encode())
    with open(path, "rb") as f:
        h.update(f.read())
    return h.hexdigest()


def cuts(text: str, size: int) -> list[str]:
    """``text`` in stretches of about ``size`` characters, cut between a character that is not blank and a space or newline.

    Only for tokenizers that cut there themselves before they merge: tokens of the stretches are then those of the text.
    """
    out, lo = [], 0
    while len(text) - lo > size:
        at = lo + size
        while True:
            at = min((k for k in (text.find(" ", at), text.find("\n", at)) if k >= 0), default=-1)
            if at < 0 or not text[at - 1].isspace():
                break
            at += 1
        if at < 0:
            break
        out.append(text[lo:at])
        lo = at
    return [*out, text[lo:]]


def cuts_at_blanks(path: str) -> bool:
    """Whether a tokenizer of the tokenizers library never joins a character that is not blank with a blank behind it."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    plain = all(" " not in t["content"] and "\n" not in t["content"] and not t["lstrip"] and not t["rstrip"] for t in spec["added_tokens"])
    return plain and not spec["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")


def counter(path: str, step: int = 2 << 20):
    """A function from texts to their numbers of tokens, as the file's library gives them, some megabytes of text at a time."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        encode, split = lambda part: map(len, model.encode(part, num_threads=1)), lambda text: [text]
    else:
        library = tokenizer(path)
        encode = lambda part: (len(e.ids) for e in library.encode_batch_fast(part, add_special_tokens=False))
        safe = cuts_at_blanks(path)
        split = lambda text: cuts(text, step) if safe else [text]

    def count(texts):
        out, part, owner, size = [0] * len(texts), [], [], 0

        def flush():
            for i, n in zip(owner, encode(part), strict=True):
                out[i] += n
            part.clear()
            owner.clear()

        for i, text in enumerate(texts):
            for x in split(text):
                part.append(x)
                owner.append(i)
                size += len(x)
                if size >= step:
                    flush()
                    size = 0
        if part:
            flush()
        return out

    return count


def encode_misses(texts: DataFrame, path: str, version: str) -> DataFrame:
    """(version, digest, n_tokens) of (digest, text)."""

    def run(batches):
        count = counter(path)
        for b in batches:
            digests = b.column("digest")
            n = count(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(n), pa.string()), digests, pa.array(n, pa.int64())], ["version", "digest", "n_tokens"])

    return texts.mapInArrow(run, CACHE)


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) that the cache holds for one tokenizer; two jobs may have stored the same digest."""
    try:
        rows = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def add_misses(docs: DataFrame, path: str, cache: str, text_col: str = "text") -> DataFrame:
    """Counts the texts of ``docs`` that the cache lacks, each once, appends them to it, and returns (digest, n_tokens) of its tokenizer.

    First only digests move. If all that is missing is small (its size is counted), it is broadcast and texts that are
    known never leave their task; else distinct texts are dealt out by digest, copies being dropped before they move.
    """
    spark, version = docs.sparkSession, version_of(path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    known = read_cache(spark, cache, version)
    if not known.isEmpty():
        missing = settle(texts.select("digest").distinct().join(known, "digest", "left_anti"))
        n = missing.count()
        if n == 0:
            return known
        if n * ROW_BYTES <= BROADCAST_BYTES:
            texts = texts.join(F.broadcast(missing), "digest", "left_semi").dropDuplicates(["digest"])
        else:
            texts = texts.dropDuplicates(["digest"]).join(missing, "digest", "left_semi")
    else:
        texts = texts.dropDuplicates(["digest"])
    encode_misses(texts.select("digest", "text"), path, version).write.mode("append").partitionBy("version").parquet(cache)
    return read_cache(spark, cache, version)


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), one row for each row of ``docs``.

    ``path`` is a tokenizer's file (.json: tokenizers, .model: sentencepiece), ``cache`` a folder that all executors
    share; it may be empty, hold other tokenizers' counts, or be written by several jobs. A text is known by the sha256
    of its UTF-8 bytes, nulls being empty texts, and a tokenizer by that of its file and library. Repeated rows are
    encoded once and counted each; further columns are ignored. Very long texts are encoded in stretches where that
    gives the same tokens, else whole.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    asked = docs.select(F.col(id_col), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    stored = add_misses(docs, path, cache, text_col)
    out = asked.join(stored.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d"))
    return out.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
