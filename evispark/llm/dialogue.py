"""Repair of damaged conversations by aligning their turns with the alternating grammar."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evispark.llm.common import settle

# Costs of the edits; a truncated turn that stays adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
OK, BLANK, DUPLICATE, CUT = range(4)
# What has been put out so far: nothing, the system turn, a user's turn, an assistant's turn.
NONE, SYSTEM, USER, ASSISTANT = range(4)
PIECE = 256
FAR = 1 << 60
BLANKS = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}


def filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with faults dealt out by crc32(``conv_id:turn``) % 20.

    0 drops the row, 1 empties its text, 2 takes out its ``[.!?]``, 3 repeats it, 4 makes it a user's. Nulls read as one space.
    """
    fate = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (
        turns.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), fate.alias("fate"))
        .filter("fate != 0")
        .select(
            "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
            F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
        )
        .drop("copy")
    )


def faults(turns: DataFrame) -> DataFrame:
    """Each row with its first fault: blank, a duplicate of an earlier turn of the same role and text, or cut off.

    Equal rows are counted before anything moves, so a turn that is repeated a million times is one row until the end.
    The first of equal role and text is found by a grouped minimum that comes back in a join, which Spark can split.
    """
    runs = turns.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    runs = runs.withColumn("digest", F.sha2("text", 256))
    first = runs.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.max(F.col("turn").isNull()).alias("open"), F.min("turn").alias("low"))
    trimmed = F.rtrim("text", F.lit(BLANKS))
    later = (F.col("copy") > 1) | F.when(F.col("open"), F.col("turn").isNotNull()).otherwise(F.col("turn") != F.col("low"))
    fault = F.when(trimmed == "", BLANK).when(later, DUPLICATE).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), CUT).otherwise(OK)
    return (
        runs.join(first, runs["conv_id"].eqNullSafe(first["c"]) & (runs["role"] == first["r"]) & (runs["digest"] == first["d"]))
        .select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
        .select("conv_id", "turn", "role", "text", "copy", fault.alias("fault"))
    )


class Alignment:
    """Wagner-Fischer tables of a run of turns against every length of the alternating string.

    ``letter(m)`` is the m-th letter from the end of a target that ends with ``last``. Targets that end alike are
    suffixes of one another, so one table, anchored at the end, holds the alignments with all of them: ``cost(i, m)``
    is the least cost of turning rows i, i + 1, ... into the last m letters. A row of the table is kept only where a
    path of at most ``limit``, the incumbent's cost, can run: each letter too many is an insertion, each row too many
    a deletion (Ukkonen's band).
    """

    def __init__(self, initials: list[str], faults: list[int], last: str, limit: int):
        self.initials, self.last, n = initials, last, len(initials)
        self.keep = [FAR if f in (BLANK, DUPLICATE) else TRUNCATED if f == CUT else 0 for f in faults]
        self.other = "a" if last == "u" else "u"
        self.low, self.rows = [0] * (n + 1), [[]] * (n + 1)
        must = 0
        for i in range(n, -1, -1):
            left = n - i
            must += i < n and self.keep[i] == FAR
            low, high = max(0, left - limit // DELETE), left - must + max(0, limit - DELETE * must) // INSERT
            self.low[i] = low
            if i == n:
                self.rows[i] = [INSERT * m for m in range(high + 1)]
                continue
            row = []
            for m in range(low, high + 1):
                best = self.cost(i + 1, m) + DELETE
                if m:
                    best = min(best, self.cost(i + 1, m - 1) + self.change(i, m), (row[-1] if row else FAR) + INSERT)
                row.append(min(best, FAR))
            self.rows[i] = row

    def letter(self, m: int) -> str:
        return self.last if m % 2 else self.other

    def change(self, i: int, m: int) -> int:
        return self.keep[i] + REROLE * (self.initials[i] != self.letter(m))

    def cost(self, i: int, m: int) -> int:
        k = m - self.low[i]
        return self.rows[i][k] if 0 <= k < len(self.rows[i]) else FAR

    def lengths(self, i: int, odd: int, least: int) -> tuple[int, list[int]]:
        """The least cost of the rows from i on over the lengths of one parity, and the lengths that have it."""
        by = {m: self.cost(i, m) for m in range(self.low[i], self.low[i] + len(self.rows[i])) if m % 2 == odd and m >= least}
        low = min(by.values(), default=FAR)
        return low, [m for m, c in by.items() if c == low < FAR]

    def audit(self, i: int, m: int) -> str:
        """The cheapest edits in order; where several are, the one that comes first in ASCII."""
        out, n = [], len(self.initials)
        while i < n or m:
            now = self.cost(i, m)
            if i < n and self.cost(i + 1, m) + DELETE == now:
                out.append("D")
                i += 1
            elif m and self.cost(i, m - 1) + INSERT == now:
                out.append("I")
                m -= 1
            else:
                out.append("K" if self.initials[i] == self.letter(m) else "R")
                i, m = i + 1, m - 1
        return "".join(out)


def align(initials: list[str], faults: list[int], whole: bool) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) of the cheapest edits of a run of turns, ties to the least audit.

    ``whole``: from nothing to an end that the grammar allows, one row. Else for each pair of states that a longer
    conversation may have before and after this run.
    """
    n = len(initials)
    found: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(before: int, after: int, cost: int, audit: str):
        if cost < FAR:
            found[before, after] = min(found.get((before, after), (FAR, "")), (cost, audit))

    def incumbent(want: str) -> int:
        """Every turn that may stay becomes the letter that comes next."""
        cost = 0
        for c, f in zip(initials, faults, strict=True):
            if f in (BLANK, DUPLICATE):
                cost += DELETE
            else:
                cost += TRUNCATED * (f == CUT) + REROLE * (c != want)
                want = "a" if want == "u" else "u"
        return cost

    # One letter more mends a wrong end, two an empty run.
    limit = min(DELETE * n, incumbent("u") + INSERT) if whole else max(incumbent("u"), incumbent("a")) + 2 * INSERT
    systems = [i for i in range(n) if initials[i] == "s" and faults[i] in (OK, CUT)]
    gone = (DELETE * n, "D" * n)
    offer(NONE, NONE, *gone)
    if not whole:
        for state in (SYSTEM, USER, ASSISTANT):
            offer(state, state, *gone)
        for i in systems:
            offer(NONE, SYSTEM, DELETE * (n - 1) + TRUNCATED * (faults[i] == CUT), "D" * i + "K" + "D" * (n - 1 - i))
    for after, last in ((ASSISTANT, "a"), (USER, "u"))[: 1 if whole else 2]:
        table = Alignment(initials, faults, last, limit)
        even = 0 if last == "a" else 1  # how many letters a target has that begins with a user's turn
        for before in (NONE,) if whole else (NONE, SYSTEM, ASSISTANT):
            cost, lengths = table.lengths(0, even, 1)
            for m in lengths:
                offer(before, after, cost, table.audit(0, m))
        if not whole:
            cost, lengths = table.lengths(0, 1 - even, 1)
            for m in lengths:
                offer(USER, after, cost, table.audit(0, m))
        for i in systems:  # the system turn stays, what stands before it goes
            rest, lengths = table.lengths(i + 1, even, 1)
            cost = DELETE * i + TRUNCATED * (faults[i] == CUT) + rest
            if lengths and cost <= found.get((NONE, after), (FAR, ""))[0]:
                for m in lengths:
                    offer(NONE, after, cost, "D" * i + "K" + table.audit(i + 1, m))
    if whole:
        state = min((ASSISTANT, NONE), key=lambda x: found.get((NONE, x), (FAR, "")))
        return [(NONE, state, *found[NONE, state])]
    return [(*states, *best) for states, best in found.items()]


def batches_of(rows, schema: pa.Schema, size: int = 1024):
    part = []
    for r in rows:
        part.append(r)
        if len(part) == size:
            yield pa.RecordBatch.from_pylist(part, schema)
            part = []
    if part:
        yield pa.RecordBatch.from_pylist(part, schema)


def rows_of(batches):
    for b in batches:
        names = b.schema.names
        yield from zip(*[b.column(n).to_pylist() for n in names], strict=True)


def pieces(rows):
    """Runs of at most ``PIECE`` rows of one conversation with their cheapest edits.

    Only a run that begins and ends inside this partition is known to be a whole conversation.
    """
    now, begun, inside = [], None, False

    def cut(end: bool):
        initials, flaws = [r[2] for r in now], [r[3] for r in now]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        whole = inside and end
        alternatives = [dict(zip(("before", "after", "cost", "audit"), x, strict=True)) for x in align(initials, flaws, whole)]
        counts = {"blank": flaws.count(BLANK), "duplicate": flaws.count(DUPLICATE), "truncated": flaws.count(CUT), "illegal": illegal}
        return {"conv_id": now[0][0], "start": now[0][1], "whole": whole, "first": initials[0], "last": initials[-1], "edits": alternatives} | counts

    for r in rows:
        if now and r[0] != begun:
            yield cut(True)
            now, inside = [], True
        elif now and r[1] // PIECE != now[0][1] // PIECE:
            yield cut(False)
            now, inside = [], False
        begun = r[0]
        now.append(r)
    if now:
        yield cut(False)


COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def chosen(rows, names: list[str]):
    """Puts the pieces of each conversation together, in order: the cheapest way to every state, ties to the least audit.

    Equal costs mean that neither audit is a prefix of the other, so the first letter that differs decides and earlier
    pieces keep their choice. What the audits of all states have in common is compared no more.
    """
    ways: dict[int, tuple[int, str, tuple]] = {}
    conv, last, begun = None, "", False

    def ended():
        _, _, chain = min((ways[s] for s in (NONE, ASSISTANT) if s in ways), key=lambda w: w[:2])
        out = []
        while chain:
            chain, row = chain
            out.append(row)
        return reversed(out)

    for values in rows:
        r = dict(zip(names, values, strict=True))
        if not begun or r["conv_id"] != conv:
            if begun:
                yield from ended()
            conv, begun, last, ways = r["conv_id"], True, None, {NONE: (0, "", ())}
        illegal = r["illegal"] + (last is not None and last + r["first"] not in ("su", "ua", "au"))
        last, new = r["last"], {}
        for e in r["edits"]:
            if e["before"] not in ways:
                continue
            cost, audit, chain = ways[e["before"]]
            row = {"conv_id": conv, "start": r["start"], "before": e["before"], "after": e["after"], "cost": e["cost"], "audit": e["audit"], **{c: r[c] for c in COUNTS}, "illegal": illegal}
            way = (cost + e["cost"], audit + e["audit"], (chain, row))
            if e["after"] not in new or way[:2] < new[e["after"]][:2]:
                new[e["after"]] = way
        audits = [w[1] for w in new.values()]
        low, high = min(audits), max(audits)
        same = next((k for k, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
        ways = {s: (c, a[same:], chain) for s, (c, a, chain) in new.items()}
    if begun:
        yield from ended()


def written(rows, names: list[str]):
    """One row an edit: its letter, the new role, and the place of the row it takes."""
    for values in rows:
        r = dict(zip(names, values, strict=True))
        kept, place = sum(letter != "D" for letter in r["audit"]), r["start"]
        # A target that begins with the system turn is one letter longer than the others of the same end.
        want = "s" if r["before"] == NONE and kept and kept % 2 == (r["after"] != USER) else "a" if r["before"] == USER else "u"
        for k, letter in enumerate(r["audit"]):
            role = ROLES[want] if letter in "RI" else None
            yield {"conv_id": r["conv_id"], "start": r["start"], "k": k, "edit": letter, "new_role": role, "place": None if letter == "I" else place}
            if letter != "D":
                want = "a" if want == "u" else "u"
            place += letter != "I"


def told(rows):
    """Audit and digest of each conversation, its turns passing one by one."""
    conv, begun, audit, digest, empty = None, False, [], None, True
    for c, edit, role, text in rows:
        if not begun or c != conv:
            if begun:
                yield {"conv_id": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
            conv, begun, audit, digest, empty = c, True, [], hashlib.sha256(), True
        audit.append(edit)
        if edit != "D":
            digest.update((("" if empty else "\n") + f"{role}:{text}").encode())
            empty = False
    if begun:
        yield {"conv_id": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}


def arrow(df: DataFrame, fn, schema: StructType) -> DataFrame:
    """``fn`` from rows to dicts, a partition at a time and in its order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(batches):
        yield from batches_of(fn(rows_of(batches)), to_arrow_schema(schema))

    return df.mapInArrow(run, schema)


class Repair:
    """The cheapest edits that give each conversation the roles ``(s?(ua)+)?``.

    ``edits`` has one row an edit and ``summary`` one a conversation. Keep costs 0, a new role (user or assistant) 1,
    deletion 2 (blank and duplicate turns must go), an inserted empty turn of user or assistant 5; a truncated turn that
    stays adds 5. Of equally cheap edits those count whose initials come first in ASCII.

    Turns stand in the order of ``turn`` (nulls first), then role, then text. A null role or text reads as one space; a
    null conv_id is a conversation like others; equal rows count each; further columns are ignored, whatever their names.

    Rows are sorted by ranges of all these columns, so a conversation with a third of all rows is spread over many
    tasks. Each run of at most ``PIECE`` rows is aligned by itself for every state that may come before and after it;
    only the edits (a letter a turn) of a conversation that spans runs meet in one place, as they do in its result.
    """

    def __init__(self, turns: DataFrame):
        order = ["conv_id", "turn", "role", "text", "copy"]
        rows = faults(turns).repartitionByRange(*order).sortWithinPartitions(*order)
        self.rows = settle(rows.withColumn("place", F.monotonically_increasing_id()))
        conv = self.rows.schema["conv_id"].dataType.simpleString()
        counts = ", ".join(f"{c} long" for c in COUNTS)
        narrow = self.rows.select("conv_id", "place", F.substring("role", 1, 1).alias("initial"), "fault")
        ddl = f"conv_id {conv}, start long, whole boolean, first string, last string, edits array<struct<before: int, after: int, cost: long, audit: string>>, {counts}"
        cut = settle(arrow(narrow, pieces, _schema(ddl)))
        ddl = f"conv_id {conv}, start long, before int, after int, cost long, audit string, {counts}"
        parts = cut.filter("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "start")
        names = parts.columns
        best = F.col("edits")[0]
        whole = cut.filter("whole").select("conv_id", "start", best["before"].alias("before"), best["after"].alias("after"), best["cost"].alias("cost"), best["audit"].alias("audit"), *COUNTS)
        self.choices = settle(whole.union(arrow(parts, lambda r: chosen(r, names), _schema(ddl))))
        self.conv = conv

    @property
    def edits(self) -> DataFrame:
        """(conv_id, start, k, edit, role, text) in the order of (start, k) within conv_id; deleted turns too."""
        names = self.choices.columns
        ddl = f"conv_id {self.conv}, start long, k int, edit string, new_role string, place long"
        steps = arrow(self.choices, lambda r: written(r, names), _schema(ddl))
        rows = self.rows.select("place", "role", "text")
        return steps.join(rows, "place", "left").select(
            "conv_id", "start", "k", "edit", F.coalesce("new_role", "role").alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text")
        )

    @property
    def summary(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

        A digest runs over the whole conversation, so its turns pass through one task, one by one and never held.
        """
        dealt = self.edits.repartition("conv_id").sortWithinPartitions("conv_id", "start", "k").select("conv_id", "edit", "role", "text")
        digests = arrow(dealt, told, _schema(f"conv_id {self.conv}, audit string, repaired_sha256 string"))
        sums = self.choices.groupBy(F.col("conv_id").alias("c")).agg(*[F.sum(x).alias(x) for x in (*COUNTS, "cost")])
        wide = lambda c: c.cast("decimal(20,0)")
        turns = self.rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1))).groupBy(F.col("conv_id").alias("g")).agg(
            F.coalesce((wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count("turn")).cast("long"), F.lit(0)).alias("gaps")
        )
        out = digests.join(sums, F.col("conv_id").eqNullSafe(F.col("c"))).join(turns, F.col("conv_id").eqNullSafe(F.col("g")))
        return out.select("conv_id", "gaps", *COUNTS, "cost", "audit", "repaired_sha256")


def _schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def repair(turns: DataFrame) -> DataFrame:
    """``Repair(turns).summary``."""
    return Repair(turns).summary


def repair_damaged(turns: DataFrame) -> DataFrame:
    """The summary of ``turns`` after `damage`, with a row for each conversation, those of which nothing is left too."""
    done = repair(damage(turns)).withColumnRenamed("conv_id", "c")
    every = turns.select("conv_id").distinct()
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *COUNTS, "cost")]
    return every.join(done, every["conv_id"].eqNullSafe(done["c"]), "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
