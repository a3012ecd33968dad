"""Top-k and two-level ordering operators that survive one huge group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys, order, k: int, rank: str = "rank") -> DataFrame:
    """First k rows of every group.

    Written as row_number <= k so that Spark plans WindowGroupLimit: every task
    keeps k rows for each key before the shuffle, whatever the group size.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def check_limits(k: int, seed_k: int | None = None, max_depth: int = 0, decay: float = 0.0) -> None:
    """Refuse search arguments that mean nothing, before any plan is built."""
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
    if not whole(k) or k < 1:
        raise ValueError("k must be a positive integer")
    if seed_k is not None and (not whole(seed_k) or seed_k < 1):
        raise ValueError("seed_k must be a positive integer or None")
    if not whole(max_depth) or max_depth < 0:
        raise ValueError("max_depth must be an integer of 0 or more")
    if isinstance(decay, bool) or not 0.0 <= float(decay) <= 1.0:
        raise ValueError("decay must be between 0 and 1")


def by_score(score: str = "score", ident: str = "doc_id"):
    """Score descending on 9 decimals, then id, so engines agree on ties."""
    return [F.round(F.col(score), 9).desc(), F.col(ident).asc()]


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate (no grouping keys) to every row."""
    return df.join(F.broadcast(one_row))


def _bounded(keys, block: str, order):
    return Window.partitionBy(*keys, block).orderBy(*order)


def dense_index(df: DataFrame, block: Column, order, out: str, keys=()) -> DataFrame:
    """0-based dense position along ``block, order`` without a global window.

    Rows are numbered inside blocks; block sizes (one row each) give the
    offsets. ``block`` must follow the order, e.g. ``id div 65536``.
    """
    keys = list(keys)
    df = df.withColumn("_blk", block)
    local = df.withColumn("_rn", F.row_number().over(_bounded(keys, "_blk", order)))
    sizes = df.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        local.join(offsets, [*keys, "_blk"])
        .withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("bigint"))
        .drop("_blk", "_rn", "_n", "_off")
    )


def carry_forward(df: DataFrame, keys, block: Column, order, values: dict, inclusive: bool = False) -> DataFrame:
    """Last non-null value at or before every row, for each of ``values``.

    The windowed part runs inside (keys, block); what earlier blocks carry in
    comes from one summary row for each block. A key holding a third of the
    table is thereby split over its blocks.
    """
    keys = list(keys)
    df = df.withColumn("_blk", block)
    end = 0 if inclusive else -1
    w = _bounded(keys, "_blk", order).rowsBetween(Window.unboundedPreceding, end)
    local = df.select("*", *[F.last(v, ignorenulls=True).over(w).alias(f"_l_{n}") for n, v in values.items()])
    flat = df.select(
        *keys, "_blk", F.struct(*order_values(order)).alias("_o"),
        *[v.alias(f"_v_{n}") for n, v in values.items()],
    )
    summary = flat.groupBy(*keys, "_blk").agg(
        *[
            F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col("_o"))).alias(f"_s_{n}")
            for n in values
        ]
    )
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys, "_blk", *[F.last(f"_s_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in values]
    )
    joined = local.join(carried, [*keys, "_blk"], "left")
    out = [c for c in df.columns if c != "_blk"]
    return joined.select(*out, *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in values])


def order_values(order):
    return [F.col(c) if isinstance(c, str) else c for c in order]


def previous_and_next(df: DataFrame, keys, order: str, width: int, value: Column) -> DataFrame:
    """LAG and LEAD of ``value`` along a unique integer ``order`` column.

    Blocks of ``width`` consecutive orders hold at most ``width`` rows.
    """
    tagged = df.withColumn("_val", value).withColumn("_neg", -F.col(order))
    blk = F.floor(F.col(order) / width)
    back = carry_forward(tagged, keys, blk, [order], {"prev_value": F.col("_val")})
    both = carry_forward(back, keys, F.floor(F.col("_neg") / width), ["_neg"], {"next_value": F.col("_val")})
    return both.drop("_val", "_neg")


def exact_percentiles(df: DataFrame, keys, value: str, positions: dict, accuracy: int = 10000) -> DataFrame:
    """Exact order statistics of big groups.

    ``positions`` maps an output name to a function of the group size (a
    Column) giving a 0-based, possibly fractional position; fractional ones are
    interpolated. A sketch first brackets each position; only the distinct
    values inside the brackets, up to 4 of 64 cells of them, are ranked exactly.
    """
    keys = list(keys)
    names = list(positions)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    sizes = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("_total"),
            F.percentile_approx(value, [i / 64 for i in range(65)], accuracy).alias("_grid"),
        )
    )
    for n in names:
        sizes = sizes.withColumn(f"_p_{n}", positions[n](F.col("_total")).cast("double"))
    # A value's cell is the number of inner grid points below it. Wanted are the
    # cells between the grid values around each position, one point of slack
    # each side; small groups are ranked whole.
    span = F.greatest(F.col("_total") - 1, F.lit(1))
    inner = F.slice("_grid", 2, 63)
    cell_of = lambda v: F.size(F.filter(inner, lambda g: g < v))
    near = []
    for n in names:
        at = F.floor(F.col(f"_p_{n}") / span * 64).cast("int")
        low = F.get("_grid", F.greatest(F.lit(0), at - 1))
        high = F.get("_grid", F.least(F.lit(64), at + 2))
        near.append(F.sequence(cell_of(low), cell_of(high)))
    everything = F.sequence(F.lit(0), F.lit(63))
    sizes = sizes.withColumn(
        "_want", F.when(F.col("_total") <= 4096, everything).otherwise(F.array_distinct(F.flatten(F.array(*near))))
    )
    if keys:
        cells = counts.join(sizes, keys)
    else:
        cells = attach_row(counts, sizes)
    cells = cells.withColumn("_cell", cell_of(F.col(value)))
    per_cell = cells.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_cn"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_cell.select(*keys, "_cell", F.coalesce(F.sum("_cn").over(before), F.lit(0)).alias("_off"))
    inside = cells.filter(F.array_contains("_want", F.col("_cell").cast("int"))).join(
        offsets, [*keys, "_cell"]
    )
    w = Window.partitionBy(*keys, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("_hi", F.col("_off") + F.sum("_n").over(w) - 1).withColumn(
        "_lo", F.col("_hi") - F.col("_n") + 1
    )
    picks = []
    for n in names:
        p = F.col(f"_p_{n}")
        for tag, at in (("f", F.floor(p)), ("c", F.ceil(p))):
            picks.append(
                F.max(F.when((F.col("_lo") <= at) & (at <= F.col("_hi")), F.col(value))).alias(f"_{tag}_{n}")
            )
        picks.append(F.max(p).alias(f"_q_{n}"))
    got = ranked.groupBy(*keys).agg(*picks)
    return got.select(
        *keys,
        *[
            (F.col(f"_f_{n}") + (F.col(f"_c_{n}") - F.col(f"_f_{n}")) * (F.col(f"_q_{n}") - F.floor(f"_q_{n}"))).alias(n)
            for n in names
        ],
    )


def linear(p: float):
    """Position of the linearly interpolated quantile p."""
    return lambda n: (n - 1) * F.lit(float(p))


def upper_median():
    return lambda n: F.floor(n / 2)


def lower_index(p: float):
    """Position int(p * (n - 1))."""
    return lambda n: F.floor((n - 1) * F.lit(float(p)))
