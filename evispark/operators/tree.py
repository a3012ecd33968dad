"""Outline trees and as-of joins along one ordered sequence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.operators.ranking import carry_forward, previous_and_next


def outline_parents(rows: DataFrame, keys, levels: int, width: int = 4096) -> DataFrame:
    """Adds parent: the order of the last earlier row of a smaller level.

    ``rows`` has keys, ord (unique integer) and level 1..levels.
    """
    last = {f"_at{i}": F.when(F.col("level") == i, F.col("ord")) for i in range(1, levels)}
    c = carry_forward(rows, keys, F.floor(F.col("ord") / width), ["ord"], last)
    above = F.array(*[F.when(F.col("level") > i, F.col(f"_at{i}")) for i in range(1, levels)])
    return c.withColumn("parent", F.array_max(above)).drop(*last)


def outline_paths(nodes: DataFrame, keys, levels: int, titles: str | None = None) -> DataFrame:
    """Adds depth and title_path by joining up the parents, one level a join; ``titles`` keeps the path as an array too."""
    keys = list(keys)
    up = nodes.select(*keys, F.col("ord").alias("_up"), F.col("parent").alias("_next"), F.col("title").alias("_t"))
    out = nodes.withColumn("_up", F.col("parent")).withColumn("_path", F.array("title"))
    for _ in range(levels - 1):
        out = out.join(up, [*keys, "_up"], "left").withColumn(
            "_path", F.when(F.col("_t").isNotNull(), F.concat(F.array("_t"), "_path")).otherwise(F.col("_path"))
        ).drop("_up", "_t").withColumnRenamed("_next", "_up")
    out = out.withColumn("depth", F.size("_path")).withColumn("title_path", F.array_join("_path", " > ")).drop("_up")
    return out.withColumnRenamed("_path", titles) if titles else out.drop("_path")


def child_counts(nodes: DataFrame, keys) -> DataFrame:
    """Adds child_count."""
    keys = list(keys)
    n = nodes.filter("parent is not null").groupBy(*keys, F.col("parent").alias("ord")).agg(F.count(F.lit(1)).alias("child_count"))
    return nodes.join(n, [*keys, "ord"], "left").withColumn("child_count", F.coalesce("child_count", F.lit(0)))


def siblings(nodes: DataFrame, keys, width: int = 4096) -> DataFrame:
    """Adds prev_sibling and next_sibling: neighbours with the same parent."""
    n = nodes.withColumn("_parent", F.coalesce("parent", F.lit(-1)))
    both = previous_and_next(n, [*keys, "_parent"], "ord", width, F.col("ord"))
    return both.withColumnRenamed("prev_value", "prev_sibling").withColumnRenamed("next_value", "next_sibling").drop("_parent")


def as_of(rows: DataFrame, boundaries: DataFrame, keys, order: list[str], block: Column, value: str) -> DataFrame:
    """Each row with the value of the latest boundary at or before it.

    Backward and inclusive. Both relations share ``keys`` and ``order``; blocks
    (of the first order column) split a key that holds much of the data.
    """
    keys = list(keys)
    marks = boundaries.select(*keys, *order, F.lit(0).alias("_row"), F.col(value).alias("_b"))
    body = rows.withColumn("_row", F.lit(1))
    both = body.unionByName(marks, allowMissingColumns=True)
    filled = carry_forward(both, keys, block, [*order, "_row"], {value: F.col("_b")}, inclusive=True)
    return filled.filter("_row = 1").select(*rows.columns, value)


def sibling_suffix(nodes: DataFrame, keys, base: str) -> DataFrame:
    """Adds slug, unique under each parent: the base, or with the first unused of -2, -3, ...

    Siblings take their names in ``ord`` order. Only names that agree up to
    trailing numbers can meet, so these are one group, not all of a parent's
    children. Groups travel as rows, many to a batch; one without equal bases
    keeps them and is not renamed in Python.
    """
    keys = list(keys)
    stem = F.regexp_replace(F.col(base), r"(-\d+)+$", "")

    @F.pandas_udf("array<string>")
    def renamed(groups: pd.Series) -> pd.Series:
        return groups.map(lambda g: None if g is None else unique_names(g))

    rest = [c for c in nodes.columns if c not in (*keys, "parent", "ord")]
    groups = nodes.groupBy(*keys, "parent", stem.alias("_stem")).agg(F.collect_list(F.struct("ord", *rest)).alias("_g"))
    groups = groups.withColumn("_g", F.array_sort("_g", lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)))
    names = F.col("_g")[base]
    groups = groups.withColumn("_slugs", renamed(F.when(F.size(F.array_distinct(names)) < F.size(names), names)))
    rows = F.arrays_zip(F.col("_g").alias("row"), F.coalesce("_slugs", names).alias("slug"))
    return groups.select(*keys, "parent", F.explode(rows).alias("_e")).select(*[F.col(c) if c in (*keys, "parent") else F.col(f"_e.row.{c}") for c in nodes.columns], F.col("_e.slug").alias("slug"))


def unique_names(bases) -> list[str]:
    """Each base as it is, or with the first unused of -2, -3, ..."""
    used, free, out = set(), {}, []
    for b in bases:
        slug, n = b, free.get(b, 2)
        while slug in used:
            slug, n = f"{b}-{n}", n + 1
        free[b] = n  # lower numbers are taken for good
        used.add(slug)
        out.append(slug)
    return out


def slug_collisions(nodes: DataFrame, keys) -> DataFrame:
    return nodes.groupBy(*keys, "parent", "slug").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def cross_references(topics: DataFrame, most: int = 20) -> DataFrame:
    """(ord, target, pos): sections a topic's text mentions, by number.

    ``topics`` has ord, section_number, text. A number used twice means its
    last topic; a topic never refers to itself and keeps its first ``most``.
    """
    from evispark.functions.text import section_references
    from evispark.operators.ranking import top_k

    said = topics.select("ord", F.posexplode(section_references(F.col("text"))).alias("pos", "section_number"))
    last = topics.filter("section_number is not null").groupBy("section_number").agg(F.max("ord").alias("target"))
    found = said.join(last, "section_number").filter("ord <> target")
    return top_k(found, ["ord"], ["pos"], most, "_r").select("ord", "target", "pos")
