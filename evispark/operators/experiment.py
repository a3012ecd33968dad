"""Schedules, resume, upserts, exports, digests, pilots and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.errors import EvidenceError
from evispark.operators.ranking import attach_row, dense_index, top_k
from evispark.session import settle


def factorial_schedule(questions: DataFrame, order: str, block: Column, flows, conditions, seed: int = 42) -> DataFrame:
    """(schedule_index, qid, flow, condition): every cell once.

    Questions keep their order; flows are shuffled within a question and
    conditions within a flow by md5 of the seeded key. The index is computed
    from the question's dense position, so no global sort is needed.
    """
    flows, conditions = list(flows), list(conditions)
    q = dense_index(questions.select("qid", order), block, [order], "_q")
    lit_array = lambda xs: F.array(*[F.lit(x) for x in xs])
    cells = q.select("qid", "_q", F.explode(lit_array(flows)).alias("flow")).select(
        "qid", "_q", "flow", F.explode(lit_array(conditions)).alias("condition")
    )
    digest = lambda *c: F.md5(F.concat_ws("|", F.lit(str(seed)), *c).cast("binary"))
    n = len(flows) * len(conditions)
    placed = top_k(cells, ["qid"], [digest("qid", "flow"), digest("qid", "flow", "condition")], n, "_pos")
    return placed.select(
        (F.col("_q") * n + F.col("_pos") - 1).cast("bigint").alias("schedule_index"), "qid", "flow", "condition"
    )


def remaining(schedule: DataFrame, done: DataFrame, keys) -> DataFrame:
    """What is still to run after a restart."""
    return schedule.join(done.select(*keys).distinct(), list(keys), "left_anti")


def latest(rows: DataFrame, keys, sequence: str) -> DataFrame:
    """Newest row of every key: upsert semantics over an append-only table.

    max_by combines map-side, so a key written a billion times shuffles one row
    from every task.
    """
    keys = list(keys)
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(sequence)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)


def joined_export(answers: DataFrame, judged: DataFrame, keys) -> DataFrame:
    """Answers with their judge row when there is one; arrays, maps and structs as JSON text."""
    joined = answers.join(judged, list(keys), "left")
    nested = [n for n, t in joined.dtypes if t.startswith(("array", "map", "struct"))]
    return joined.withColumns({n: F.to_json(n) for n in nested}) if nested else joined


def duplicate_keys(rows: DataFrame, keys) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def require_empty(violations: DataFrame, error: type[Exception] = EvidenceError, what: str = "gate") -> None:
    """Raise when a gate returns rows; shows the first few."""
    rows = violations.take(5)
    if rows:
        raise error(f"{what}: {[r.asDict() for r in rows]}")


def benchmark_violations(q: DataFrame, tenant: str | None = None) -> DataFrame:
    """(rule, qid) for every breach of the gold contract.

    ``q`` has qid, question, reference_answer, answerable, expected_pages, corpus.
    """
    n_pages = F.coalesce(F.size("expected_pages"), F.lit(0))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    rules = [
        F.when(blank("question"), F.lit("empty_question")),
        F.when(blank("reference_answer"), F.lit("empty_reference")),
        F.when(F.col("answerable").isNull(), F.lit("answerable_missing")),
        F.when(F.col("answerable") & (n_pages == 0), F.lit("answerable_without_pages")),
        F.when(~F.col("answerable") & (n_pages > 0), F.lit("control_with_pages")),
        F.when(F.exists("expected_pages", lambda p: p < 1), F.lit("page_below_one")),
    ]
    if tenant is not None:
        rules.append(F.when(F.col("corpus") != tenant, F.lit("foreign_tenant")))
    rows = q.select(F.explode(F.array_compact(F.array(*rules))).alias("rule"), "qid")
    twice = duplicate_keys(q, ["qid"]).select(F.lit("duplicate_qid").alias("rule"), "qid")
    return rows.unionByName(twice)


def benchmark_counts(q: DataFrame) -> DataFrame:
    return q.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("answerable").alias("answerable"),
        F.count_if(~F.col("answerable")).alias("negative_or_control"),
        F.count_if(F.size("expected_pages") > 0).alias("with_expected_pages"),
    )


def patched(base: DataFrame, patches: DataFrame, key: str, columns) -> DataFrame:
    """Per-row overrides; a patched FALSE or empty value still overwrites."""
    p = patches.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_p_{c}") for c in columns])
    j = base.join(p, key, "left")
    return j.select(
        *[
            F.when(F.col("_hit"), F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in base.columns
        ]
    )


def excluded(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def superseded(cells: DataFrame, keys, questions: DataFrame, single: DataFrame | None = None) -> DataFrame:
    """Rows of ``cells`` that were withdrawn after review: by their question (column qid), or cell by cell.

    A gate calls `require_empty` on it; both lists are short and hold no cell twice.
    """
    gone = cells.join(questions.select("qid").distinct(), "qid", "left_semi").select(*cells.columns)
    if single is not None:
        gone = gone.unionByName(cells.join(single.select(*keys).distinct(), list(keys), "left_semi").select(*cells.columns)).distinct()
    return gone


def store_snapshot(rows: DataFrame, corpus: str, vector: str) -> DataFrame:
    """(corpus, n, dimensions, without_vector): the histogram of a store and the set of its vectors' sizes, as text."""
    sizes = F.array_sort(F.collect_set(F.when(F.col(vector).isNotNull(), F.size(vector))))
    return rows.groupBy(corpus).agg(
        F.count(F.lit(1)).alias("n"), F.array_join(sizes.cast("array<string>"), ",").alias("dimensions"), F.count_if(F.col(vector).isNull()).alias("without_vector")
    )


def pilot_sample(q: DataFrame, n: int) -> DataFrame:
    """Deterministic pilot: the first control, then the first answerable
    question of every unused category, then the rest in order.

    ``q`` has ord, qid, category, answerable.
    """
    first = q.filter(~F.col("answerable")).agg(
        F.min_by("category", "ord").alias("_c0"), F.min("ord").alias("_o0")
    )
    heads = q.filter("answerable").groupBy("category").agg(F.min("ord").alias("_head"))
    j = attach_row(q.join(heads, "category", "left"), first)
    control = F.col("ord") == F.col("_o0")
    head = F.col("answerable") & (F.col("ord") == F.col("_head")) & ~F.coalesce(F.col("category") == F.col("_c0"), F.lit(False))
    turn = F.when(F.coalesce(control, F.lit(False)), 0).when(head, 1).otherwise(2)
    return j.withColumn("turn", turn).orderBy("turn", "ord").limit(n).select("qid", "category", "answerable", "turn")


def stratified_pilot(q: DataFrame, strata, per_stratum: int, seed: int = 42) -> DataFrame:
    """Hash-ordered sample of every stratum."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("qid").cast("string")).cast("binary"))
    return top_k(q, list(strata), [order, F.col("qid")], per_stratum)


def _digest_levels(rows: DataFrame, keys, path: str, sha: str, levels: int) -> list[DataFrame]:
    """Nodes (keys, _h, _d, _n, _p) of the digest tree, the lowest first and the root last."""
    name, out = F.col(path).cast("string"), []
    level = rows.select(*keys, F.sha2(name, 256).alias("_h"), name.alias("_p"), F.col(sha).alias("_d"), F.lit(1).cast("bigint").alias("_n"))
    for digits in range(3 * levels, -1, -3):
        line = F.concat("_p", F.lit("\0"), "_d", F.lit("\n"))
        lines = F.sort_array(F.collect_list(F.struct(F.col("_p").alias("p"), line.alias("l"))))
        level = (
            level.groupBy(*keys, F.substring("_h", 1, digits).alias("_h"))
            .agg(F.sha2(F.array_join(F.transform(lines, lambda x: x["l"]), ""), 256).alias("_d"), F.sum("_n").alias("_n"))
            .withColumn("_p", F.col("_h"))
        )
        out.append(level)
    return out


def tree_digest(rows: DataFrame, keys, path: str, sha: str, levels: int = 3) -> DataFrame:
    """(keys, n_files, digest) of an inventory, as a tree of fixed depth.

    A leaf is a file's line ``path NUL digest LF``. Nodes are prefixes of the
    sha256 of the path, three hex digits a level, ``levels`` levels and a root;
    a node's digest is the sha256 of its children's lines in the order of their
    names, an inner child's line being ``prefix NUL digest LF``. One definition
    holds for every size: inner nodes have 4,096 children at most, and the
    files of a lowest node are as evenly dealt as the hash is.
    """
    keys = list(keys)
    root = _digest_levels(rows, keys, path, sha, levels)[-1]
    return root.select(*keys, F.col("_n").alias("n_files"), F.col("_d").alias("digest"))


def tree_differences(before: DataFrame, after: DataFrame, path: str = "path", sha: str = "sha256", levels: int = 2) -> DataFrame:
    """(path, problem) of two builds, found from the root of their digest trees down.

    Each inventory is read once; both trees are built from it and settled. Where two nodes have the same digest,
    nothing below them is read again: of equal builds two roots are compared and no file. ``before`` and ``after`` are
    inventories (path, sha256); problems are those of `inventory_mismatch`.
    """
    before, after = (settle(rows.select(F.col(path).cast("string").alias("path"), F.col(sha).alias("sha256"))) for rows in (before, after))
    path, sha = "path", "sha256"
    trees = [[settle(n.select("_h", "_d")) for n in _digest_levels(rows, [], path, sha, levels)] for rows in (before, after)]
    differ = None
    for depth in range(levels, -1, -1):
        sides = [t[depth] for t in trees]
        if differ is not None:
            # a node's name begins with that of the node above it
            up = differ.select(F.col("_h").alias("_up"))
            sides = [n.join(F.broadcast(up), F.substring("_h", 1, 3 * (levels - depth - 1)) == F.col("_up"), "left_semi") for n in sides]
        new = sides[1].select("_h", F.col("_d").alias("_e"))
        differ = sides[0].join(new, "_h", "full_outer").filter(~F.col("_d").eqNullSafe(F.col("_e"))).select("_h")
        if depth:
            differ = settle(differ)  # at most 4,096 names on the level above the files' nodes
            if differ.isEmpty():
                return before.sparkSession.createDataFrame([], "path string, problem string")
    node = lambda rows: rows.withColumn("_h", F.substring(F.sha2(F.col(path).cast("string"), 256), 1, 3 * levels)).join(differ, "_h", "left_semi").drop("_h")
    return inventory_mismatch(node(before), node(after), path, sha)


def inventory_mismatch(expected: DataFrame, actual: DataFrame, path: str = "path", sha: str = "sha256") -> DataFrame:
    """(path, problem): missing, unexpected or changed files, or rows of a store."""
    e = expected.select(F.col(path).alias("path"), F.col(sha).alias("_e"))
    a = actual.select(F.col(path).alias("path"), F.col(sha).alias("_a"))
    j = e.join(a, "path", "full_outer")
    problem = (
        F.when(F.col("_a").isNull(), F.lit("missing")).when(F.col("_e").isNull(), F.lit("unexpected"))
        .when(F.col("_a") != F.col("_e"), F.lit("changed"))
    )
    return j.select("path", problem.alias("problem")).filter("problem is not null")


def record_violations(records: DataFrame, schedule: DataFrame, keys) -> DataFrame:
    """(rule, keys) for stored records that must not be resumed from.

    ``records`` carry answer, answer_sha256, tokens_total and invocations, an
    array of structs with a tokens field; each must belong to a scheduled cell,
    match its digest and account for every call.
    """
    keys = list(keys)
    known = schedule.select(*keys, F.lit(True).alias("_known")).distinct()
    spent = F.aggregate("invocations", F.lit(0).cast("bigint"), lambda s, x: s + x["tokens"])
    rules = F.array_compact(
        F.array(
            F.when(F.col("_known").isNull(), F.lit("unknown_cell")),
            F.when(~F.sha2("answer", 256).eqNullSafe(F.col("answer_sha256")), F.lit("answer_digest")),
            F.when(~spent.eqNullSafe(F.col("tokens_total").cast("bigint")), F.lit("token_accounting")),
            F.when(F.size("invocations") < 1, F.lit("no_invocation")),
        )
    )
    return records.join(known, keys, "left").select(F.explode(rules).alias("rule"), *keys)
