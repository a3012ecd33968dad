"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.llm.common import free_names

UNKNOWN = "und"
U = np.uint64
MIX = U(0x9E3779B97F4A7C15)


def grams_of(data: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` + 1 bytes at each place, the newest lowest, as one number."""
    out = data.astype(U)
    g = out.copy()
    for k in range(1, order + 1):
        g[k:] |= out[:-k] << U(8 * k)
    return g


class Ppm:
    """Context trees of all languages with frozen statistics.

    A tree of order ``order`` counts the bytes seen behind each context of 0 to
    ``order`` bytes. The code length of a byte is found at the longest context
    in the tree; if the byte is new there, an escape is paid (as many chances
    as the context has followers) and the next shorter context is asked, with
    the bytes that the longer one has excluded. Behind order 0 all bytes left
    are equally likely. ``cost`` holds the exact code lengths in bits of all
    longest grams that any language has seen, in a hash table; others are
    worked out from the trees.
    """

    def __init__(self, langs: list[str], order: int, counts: list[list[tuple[np.ndarray, np.ndarray]]]):
        self.langs, self.order = langs, order
        self.trees = [self._tree(c) for c in counts]
        keys = np.unique(np.concatenate([c[order][0] for c in counts])) if langs else np.zeros(0, U)
        bits = max(10, int(len(keys) * 2).bit_length())
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.slot_key = np.full(1 << bits, ~U(0), U)
        self.slot_cost = np.zeros((1 << bits, len(langs)), np.float32)
        cost = np.stack([self._costs(t, keys) for t in self.trees], axis=1).astype(np.float32) if len(keys) else None
        home = self._home(keys)
        left = np.arange(len(keys))
        while len(left):  # open addressing, all keys that still look for a slot at once
            free = left[self.slot_key[home[left]] == ~U(0)]
            place, first = np.unique(home[free], return_index=True)
            won = free[first]
            self.slot_key[place], self.slot_cost[place] = keys[won], cost[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            home[left] = (home[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * MIX >> self.shift).astype(np.int64)

    def _tree(self, counts):
        """Per order: sorted grams and counts; contexts with sums plain and behind an escape from the longer context."""
        out = []
        for k in range(self.order + 1):
            grams, n = counts[k]
            ctx, first = np.unique(grams >> U(8), return_index=True)
            total = np.add.reduceat(n, first) if len(n) else n
            kinds = np.diff(np.append(first, len(grams)))
            out.append({"grams": grams, "n": n, "ctx": ctx, "total": total, "kinds": kinds})
        for k in range(1, self.order + 1):
            # what is left of the shorter context once the followers of this one are excluded
            here, short = out[k], out[k - 1]
            low = U((1 << 8 * k) - 1) if k < 8 else ~U(0)
            same = np.searchsorted(short["grams"], here["grams"] & low)
            taken = short["n"][same]
            first = np.searchsorted(here["grams"] >> U(8), here["ctx"])
            gone = np.add.reduceat(taken, first) if len(taken) else taken
            parent = np.searchsorted(short["ctx"], here["ctx"] & (low >> U(8)))
            here["rest_total"] = short["total"][parent] - gone
            here["rest_kinds"] = short["kinds"][parent] - here["kinds"]
        return out

    def _costs(self, tree, grams: np.ndarray) -> np.ndarray:
        """Exact code lengths of the last byte of each gram of the full order."""
        n = len(grams)
        bits, open_, escaped_from = np.zeros(n), np.ones(n, bool), np.full(n, -1)
        for k in range(self.order, -1, -1):
            at = np.flatnonzero(open_)
            if not len(at):
                break
            t = tree[k]
            g = grams[at] & U((1 << 8 * (k + 1)) - 1)
            c = np.minimum(np.searchsorted(t["ctx"], g >> U(8)), max(len(t["ctx"]) - 1, 0))
            known = t["ctx"][c] == g >> U(8) if len(t["ctx"]) else np.zeros(len(g), bool)
            at, g, c = at[known], g[known], c[known]
            if not len(at):
                continue
            longer = escaped_from[at]
            was = longer >= 0
            total, kinds = t["total"][c].astype(float), t["kinds"][c].astype(float)
            if k < self.order:
                up = np.maximum(longer, 0)
                total = np.where(was, tree[k + 1]["rest_total"][up], total)
                kinds = np.where(was, tree[k + 1]["rest_kinds"][up], kinds)
            i = np.minimum(np.searchsorted(t["grams"], g), len(t["grams"]) - 1)
            seen = t["grams"][i] == g
            bits[at[seen]] += np.log2((total + kinds)[seen] / t["n"][i][seen])
            miss = ~seen
            # nothing left to escape from: the longer context had all followers of this one
            some = miss & (kinds > 0)
            bits[at[some]] += np.log2(((total + kinds) / np.maximum(kinds, 1))[some])
            open_[at[seen]] = False
            escaped_from[at[miss]] = c[miss]
        left = np.flatnonzero(open_)
        bits[left] += np.log2(np.maximum(256 - tree[0]["kinds"].sum(), 1))
        return bits

    def lengths(self, texts: list[bytes], window: int = 1 << 18) -> np.ndarray:
        """Code lengths in bits, one row a text and one column a language; each text starts from an empty context.

        Bytes are read ``window`` at a time, those before a window giving its contexts, and the code lengths of a text's
        windows are added up. So memory besides the texts does not depend on how long they are.
        """
        out = np.zeros((len(texts), len(self.langs)))
        sizes = np.array([len(t) for t in texts], np.int64)
        if not sizes.sum() or not self.langs:
            return out
        pad = b"\0" * self.order
        data = np.frombuffer(pad + pad.join(texts), np.uint8)
        ends = np.cumsum(sizes + self.order)
        for lo in range(0, len(data), window):
            hi, back = min(lo + window, len(data)), min(lo, self.order)
            cost = self._window_costs(grams_of(data[lo - back : hi], self.order)[back:])
            at = np.arange(lo, hi)
            text = np.minimum(np.searchsorted(ends, at, "right"), len(texts) - 1)
            cost[(at < ends[text] - sizes[text]) | (at >= ends[text])] = 0
            first = np.flatnonzero(np.diff(text, prepend=-1))
            out[text[first]] += np.add.reduceat(cost, first, axis=0, dtype=np.float64)
        return out

    def _window_costs(self, grams: np.ndarray) -> np.ndarray:
        slot = self._home(grams)
        for _ in range(64):
            wrong = np.flatnonzero((self.slot_key[slot] != grams) & (self.slot_key[slot] != ~U(0)))
            if not len(wrong):
                break
            slot[wrong] = (slot[wrong] + 1) & self.mask
        cost = self.slot_cost[slot]
        new = np.flatnonzero(self.slot_key[slot] != grams)
        if len(new):
            kinds, back = np.unique(grams[new], return_inverse=True)
            cost[new] = np.stack([self._costs(t, kinds) for t in self.trees], axis=1)[back]
        return cost


def steps(texts: list[str], most: int = 4 << 20):
    """(begin, end) of runs of texts whose bytes are some megabytes, or one text."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size < most or end == at):
            size += 4 * len(texts[end])  # a character has at most four bytes
            end += 1
        yield at, end
        at = end


def count_grams(texts: DataFrame, order: int) -> DataFrame:
    """(lang, k, gram, n) of ``texts`` (lang, text): counted inside tasks first, then added up."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for lang, rows in pdf.groupby("lang"):
                pad = b"\0" * order
                data = np.frombuffer(pad + pad.join(t.encode() for t in rows["text"]) + pad, np.uint8)
                grams = grams_of(data, order)
                full, n = np.unique(grams[data != 0], return_counts=True)  # not the filling between texts
                yield pd.DataFrame({"lang": lang, "gram": full.view(np.int64), "n": n})

    return texts.mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, per_lang: int = 300, text_bytes: int = 20_000, order: int = 4) -> Ppm:
    """Trees from a bounded sample of ``labelled`` (lang, text, doc_id).

    The sample: for each language, the ``per_lang`` distinct whole texts that
    come first by their hash, those of at most ``text_bytes`` bytes before all
    longer ones; longer ones count only while all texts of the sample stay
    within ``per_lang`` * ``text_bytes`` bytes. So a language's model has a
    bounded size, and nothing else limits what is learnt. Rows with a null
    language or text teach nothing; no rows give a model without languages.
    """
    long = (F.col("_n") > text_bytes).cast("int")
    order_by = [long, F.col("_h")]
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", "doc_id", F.xxhash64("text").alias("_h"), F.octet_length("text").cast("long").alias("_n"))
    # copies fall together first; narrow rows are ranked, within 64 parts of a language and then over these
    distinct = usable.groupBy("lang", "_h", "_n").agg(F.min("doc_id").alias("_id")).withColumn("_part", F.pmod("_h", F.lit(64)))
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    few = distinct.withColumn("_r", first("lang", "_part")).filter(F.col("_r") <= per_lang).withColumn("_r", first("lang")).filter(F.col("_r") <= per_lang)
    total = F.sum("_n").over(Window.partitionBy("lang").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))
    few = few.withColumn("_total", total).filter((F.col("_n") <= text_bytes) | (F.col("_total") <= per_lang * text_bytes))
    chosen = few.select(F.col("lang").alias("_lang"), F.col("_h").alias("_hash"), "_id")
    same = (F.col("lang") == F.col("_lang")) & (F.col("_h") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    found = usable.join(F.broadcast(chosen), same).select("lang", "_h", "text")  # per_lang rows a language
    sample = found.dropDuplicates(["lang", "_h"])  # rows repeated with their id
    rows = count_grams(sample.select("lang", "text"), order).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = []
    for lang in langs:
        own = rows[rows["lang"] == lang]
        grams, n = own["gram"].to_numpy(np.int64).view(U), own["n"].to_numpy(np.int64)
        by_order = []
        for k in range(order + 1):
            g, back = np.unique(grams & U((1 << 8 * (k + 1)) - 1), return_inverse=True)
            by_order.append((g, np.bincount(back, weights=n, minlength=len(g)).astype(np.int64)))
        counts.append(by_order)
    return Ppm(langs, order, counts)


def predict(docs: DataFrame, model: Ppm) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) for each row, in one pass without a shuffle.

    The language whose trees code the whole text shortest, ties by name; the
    score is its posterior under equal priors. A null text, one without letters
    or a model without languages gives ``und`` with score 0 and no code length.
    Texts of any length are read whole, in windows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size, see fit

    def run(batches):
        import pandas as pd

        ppm = shared.value
        for pdf in batches:
            texts = [t if ok else "" for t, ok in zip(pdf["text"], pdf["_ok"], strict=True)]
            bits = [ppm.lengths([t.encode() for t in texts[at:end]]) for at, end in steps(texts)]
            out = pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64")})
            known = pdf["_ok"].to_numpy(bool) & bool(ppm.langs)
            if ppm.langs:
                all_bits = np.concatenate(bits)
                best = all_bits.argmin(axis=1)
                least = all_bits[np.arange(len(best)), best]
                odds = np.exp2(np.maximum(least[:, None] - all_bits, -1000)).sum(axis=1)
                out["lang_pred"] = np.where(known, np.array(ppm.langs, dtype=object)[best], UNKNOWN)
                out["score"] = np.where(known, 1 / odds, 0.0)
                out["bits_per_byte"] = np.where(known, least / np.maximum([len(t.encode()) for t in texts], 1), np.nan)
            else:
                out["lang_pred"], out["score"], out["bits_per_byte"] = UNKNOWN, 0.0, np.nan
            yield out

    ok = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), ok.alias("_ok"))
    return rows.mapInPandas(run, "doc_id long, lang_pred string, score double, bits_per_byte double").withColumn(
        "bits_per_byte", F.nanvl("bits_per_byte", F.lit(None).cast("double"))
    )


def held_out(doc_id: Column) -> Column:
    """Documents that never teach: crc32 of the id as text, modulo 4, is 2. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame, per_lang: int = 300, text_bytes: int = 20_000, order: int = 4) -> DataFrame:
    """Train on the documents that are not held out and predict all of them."""
    teach = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    out = predict(docs, fit(teach, per_lang, text_bytes, order))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def keep_identified(docs: DataFrame, per_lang: int = 300, text_bytes: int = 20_000, order: int = 4) -> DataFrame:
    """Rows of ``docs`` that some language's trees code in fewer bits than plain bytes take, with that language as ``lang``.

    Rejected: null texts, texts without letters, and texts that no language
    codes below 8 bits a byte. Repeated ids are told apart by their text; very
    long texts are read whole, in windows; other columns may have any name.
    """
    teach = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    model = fit(teach, per_lang, text_bytes, order)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size a language, see fit
    (own,) = free_names(docs, "_text")

    def run(batches):
        import pyarrow as pa

        ppm = shared.value
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(own).to_pylist()]
            keep, best = np.zeros(len(texts), bool), np.zeros(len(texts), int)
            if ppm.langs:
                for at, end in steps(texts):
                    part = [t.encode() for t in texts[at:end]]
                    letters = np.array([any(c.isalpha() for c in t) for t in texts[at:end]], bool)
                    bits = ppm.lengths(part)
                    best[at:end] = bits.argmin(axis=1)
                    keep[at:end] = letters & (bits.min(axis=1) < 8.0 * np.array([len(t) for t in part]))
            at = batch.schema.get_field_index("lang")
            told = pa.array([ppm.langs[i] if k else None for i, k in zip(best, keep, strict=True)], pa.string())
            yield batch.set_column(at, "lang", told).filter(pa.array(keep)).drop_columns([own])

    rows = docs.withColumn("lang", F.col("lang").cast("string"))
    return rows.withColumn(own, F.col("text").cast("string")).mapInArrow(run, rows.schema)
