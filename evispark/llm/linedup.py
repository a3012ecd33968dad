"""Repeated line runs by a suffix array over line ids, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.llm.common import free_names, settle

DOC = ("__doc", "__text")  # a document: its id and the hash of its text


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def ranked(classes: DataFrame, order: list[str], size: str, name: str) -> DataFrame:
    """``classes`` with the number of suffixes that sort before each class.

    Two levels: classes are dealt by ranges and summed within each range; one
    row a range gives the shifts.
    """
    at = settle(classes.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = at.groupBy("_range").agg(F.sum(size).alias("_t"))
    shifts = totals.select("_range", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_shift"))
    local = at.withColumn("_local", F.coalesce(F.sum(size).over(within), F.lit(0)))
    return local.join(F.broadcast(shifts), "_range").select(*order, (F.col("_local") + F.col("_shift")).alias(name))


def lines_of(docs: DataFrame) -> DataFrame:
    """Lines with words: document, place among these, number in the text, 128-bit hash, words."""
    text = F.col("text").cast("string")
    numbered = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("no"), x.alias("line")))
    words = F.filter(numbered, lambda v: v["line"].rlike(r"\S"))
    rows = docs.select("doc_id", "text").distinct().select(F.col("doc_id").alias("__doc"), F.xxhash64(text).alias("__text"), F.posexplode(words).alias("idx", "v"))
    line = F.col("v.line")
    count = F.size(F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " "))
    return rows.select(*DOC, "idx", F.col("v.no").alias("no"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), count.alias("words"))


def repeated_runs(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """(__doc, __text, no): lines of ``docs`` (doc_id, text) that lie in a later copy of a run of ``min_words`` words or more.

    Suffixes of line ids are sorted by prefix doubling: the rank by 2h lines
    comes from the ranks, by h lines, of a suffix and of the one h lines on.
    Suffixes alone in their class drop out at once, so rounds shrink. As each
    line has a word, depth ``min_words`` is enough to tell which runs are long
    enough; longer runs are the union of these. Suffixes that share h lines are
    one interval of the suffix array with a longest common prefix of h or more,
    and ranks of two overlapping powers of two name it. In each interval, every
    place but the first (by doc_id, text hash, line), and but those that overlap
    the first, is a later copy: nine equal lines are no two runs of eight.
    """
    lines = settle(lines_of(docs))
    seen = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    names = ranked(seen, ["h1", "h2"], "n", "r0")
    at = lines.join(names, ["h1", "h2"]).select(*DOC, "idx", "no", "words", "r0")
    along = Window.partitionBy(*DOC).orderBy("idx", "no")
    level, levels = 0, ["r0"]
    while 1 << level < min_words:
        h, old, new = 1 << level, f"r{level}", f"r{level + 1}"
        at = at.withColumn("_next", F.when(F.lead("idx", h).over(along) == F.col("idx") + h, F.lead(old, h).over(along)))
        at = settle(at.withColumn("_here", F.when(F.col("_next").isNotNull(), F.col(old))))
        both = at.filter("_here is not null and _next is not null").groupBy("_here", "_next").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        at = at.join(ranked(both, ["_here", "_next"], "n", new), ["_here", "_next"], "left").drop("_here", "_next")
        level += 1
        levels.append(new)
    place = F.struct("idx", "no", "words", *levels)
    places = at.groupBy(*DOC).agg(F.sort_array(F.collect_list(place)).alias("a"))

    def grow(run):
        """Lines from the first of ``run`` on until min_words is reached; 0 if a gap or the end comes before."""

        def step(acc, x):
            fits = ~acc["done"] & (F.abs(x["idx"] - acc["at"]) <= 1)
            more = acc["sum"] + x["words"]
            return F.struct(
                F.when(fits, more).otherwise(acc["sum"]).alias("sum"), F.when(fits, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
                F.when(fits, x["idx"]).otherwise(acc["at"]).alias("at"), (acc["done"] | ~fits | (more >= min_words)).alias("done"),
            )

        start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"), run[0]["idx"].alias("at"), F.lit(False).alias("done"))
        return F.aggregate(run, start, step, lambda acc: F.when(acc["sum"] >= min_words, acc["n"]).otherwise(0))

    def windows(a):
        spots = F.sequence(F.lit(0), F.size(a) - 1)
        ahead = F.transform(spots, lambda j: F.struct(j.alias("s"), grow(F.slice(a, j + 1, min_words)).alias("h")))

        def back(j):
            begin = F.greatest(j - min_words + 1, F.lit(0))
            return let(grow(F.reverse(F.slice(a, begin + 1, j - begin + 1))), lambda h: F.struct((j - h + 1).alias("s"), h.alias("h")))

        def full(w):
            k = F.floor(F.log2(w["h"])).cast("int")
            lo, hi = a[w["s"]], a[w["s"] + w["h"] - F.element_at(F.array(*[F.lit(1 << i) for i in range(len(levels))]), k + 1)]
            rank = lambda x: F.element_at(F.array(*[x[r] for r in levels]), k + 1)
            spans = F.transform(F.slice(a, w["s"] + 1, w["h"]), lambda x: x["no"])
            return F.struct(w["h"].alias("h"), rank(lo).alias("lo"), rank(hi).alias("hi"), lo["idx"].alias("first"), spans.alias("nos"))

        both = F.array_distinct(F.concat(ahead, F.transform(spots, back)))
        return F.filter(F.transform(F.filter(both, lambda w: w["h"] > 0), full), lambda w: w["lo"].isNotNull() & w["hi"].isNotNull())

    found = settle(places.select(*DOC, F.explode(let(F.col("a"), windows)).alias("w")).select(*DOC, "w.*"))
    spot = F.struct("__doc", "__text", "first")
    firsts = found.groupBy("h", "lo", "hi").agg(F.min(spot).alias("_spot"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    inside = (F.struct("__doc", "__text") == F.struct("_spot.__doc", "_spot.__text")) & (F.col("first") < F.col("_spot.first") + F.col("h"))
    later = found.join(firsts, ["h", "lo", "hi"]).filter((spot > F.col("_spot")) & ~F.coalesce(inside, F.lit(False)))
    return later.select(*DOC, F.explode("nos").alias("no")).distinct()


def drop_repeated_lines(docs: DataFrame, min_words: int = 8, count_col: str | None = None) -> DataFrame:
    """``docs`` without later copies of repeated line runs.

    A run counts from ``min_words`` words on, within one document or across
    several; the copy with the smallest (doc_id, hash of text, line) stays whole,
    as far as it is no later copy of another run. Lines
    are told apart as they are, blanks and case included; lines without words
    count in no run and stay. A text of which all goes becomes empty; a null
    text stays null; rows equal in doc_id and text are one document and are
    treated alike. ``count_col``: lines deleted; a column of that name in the table gives way to it.
    """
    d, t, doc, text, cut = free_names(docs, "__d", "__t", "__doc", "__text", "__gone")
    gone = repeated_runs(docs.select("doc_id", "text"), min_words).groupBy(*DOC).agg(F.sort_array(F.collect_list("no")).alias(cut))
    gone = gone.withColumnsRenamed({"__doc": doc, "__text": text})
    keyed = docs.withColumns({d: F.col("doc_id"), t: F.xxhash64(F.col("text").cast("string"))})
    joined = keyed.join(gone, F.col(d).eqNullSafe(F.col(doc)) & (F.col(t) == F.col(text)), "left")
    lines = F.split(F.col("text").cast("string"), "\n", -1)

    def rest(x):
        begin = F.concat(F.array(F.lit(0)), F.transform(cut, lambda g: g + 1))
        end = F.concat(F.col(cut), F.array(F.size(x)))
        return F.flatten(F.zip_with(begin, end, lambda b, e: F.slice(x, b + 1, e - b)))

    kept = F.when(F.col(cut).isNull(), F.col("text").cast("string")).otherwise(F.array_join(let(lines, rest), "\n"))
    out = joined.withColumn("text", kept)
    if count_col:
        out = out.withColumn(count_col, F.when(F.col(cut).isNull(), 0).otherwise(F.size(cut)).cast("long"))
    return out.drop(d, t, doc, text, cut)
