"""Format-preserving pseudonyms by keyed Feistel permutations, in DataFrame operations only."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.llm.common import free_names

ROUNDS = 8
DIGITS, HEX, LOWER, UPPER = "0123456789", "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# One alternative a kind. Every repetition is bounded or possessive and starts at the edge of a run, so a scan takes linear time.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
# Country codes (E.164), none of which begins another.
THREE = r"(?:2[1-689]|3[578]|42|5[09]|6[7-9]|8[035789]|9[679])\d"
CODE = rf"(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|{THREE})"
# Numbers of digits behind the code, the usual one first.
NATIONAL = (
    (r"[17]|30|52|58|90|9[128]", (10,)), (r"27|3[134]|4[018]|56|61|9[34]", (9,)), (r"44", (10, 9)), (r"4[57]|53|65", (8,)), (r"3[26]|66", (9, 8)), (r"39", (10, 9, 11, 8)),
    (r"46", (9, 8, 7, 10)), (r"43|49", (11, 10, 9, 8, 12)), (r"54|55|86", (11, 10)), (r"20|5[17]|6[034]|8[124]|95", (10, 9, 8)), (r"62", (11, 10, 9, 12)),
)
TRUNK = r"(?:[ .-]?\(0\) ?)?"
SEEN = rf"{ADDRESS}|{DATE}|{SOCIAL}"
LONG = r"\d{13,19}(?!\d)|(?:\d{4}[ -]){3}\d{4}(?!\d)|\d{4}[ -]\d{6}[ -]\d{5}(?!\d)"


def national(n: int) -> str:
    """``n`` digits up to the edge of a group, at most one mark between two; an area code may stand in parentheses."""
    areas = "|".join(rf"\(\d{{{k}}}\)(?:[ .-]?\d){{{n - k}}}(?!\d)" for k in range(1, 6))
    return rf"[ .-]?(?:\d(?:[ .-]?\d){{{n - 1}}}(?!\d)|{areas})"


# In turn: an area code and one block, which ends a number; the lengths of the country; 8 to 15 digits that run into no other kind.
BLOCK = rf"\+(?:43|49|{THREE}){TRUNK}[ .-]?(?:\(\d{{1,4}}\)|\d{{1,4}})[ .-]\d{{5,8}}(?!\d)"
LENGTHS = "|".join(rf"\+(?:{codes}){TRUNK}(?:{'|'.join(national(n) for n in lengths)})" for codes, lengths in NATIONAL)
OTHER = rf"\+\d(?:(?:[ .-](?!{SEEN}|{LONG})|[ .-]?\(|\)[ .-]?(?!{SEEN}|{LONG}))?\d){{7,14}}(?!\d)"
LOCAL = r"(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
PHONE = rf"(?<![\w+])(?:{BLOCK}|{LENGTHS}|{OTHER})|{LOCAL}"
# All groups of digits in a row that begin no other kind, 13 digits at least; `card` looks for numbers at the edges of groups.
APART = rf"[ -](?!{EMAIL}|{SEEN}|{LOCAL})"
CARD = rf"(?<!\d)(?=\d(?:(?:{APART})?\d){{12}})\d++(?:{APART}\d++)*+"
SHAPE = r"^(?:\d{13,19}|(?:\d{4}[ -]){3}\d{4}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{4}(?:[ -]\d{3}){3})$"
ISSUER = r"^(?:4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|2(?:2[2-9]|[3-6]\d|7[01])\d{13}|3[47]\d{13}|3(?:0[0-5]|[689]\d)\d{11}|35\d{14}|6(?:011|[245]\d\d)\d{12,15})$"
ACCESS = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z])(?:password|passwd|secret|token|api_?key)[A-Za-z_]{0,16} ?[=:] ?[\"']?[0-9a-f]{16,64}(?![0-9A-Za-z])"
ANY = "|".join((EMAIL, ADDRESS, DATE, SOCIAL, PHONE, CARD, ACCESS, SECRET))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def draw(key: str, kind: str, *parts: Column) -> Column:
    """A keyed number of 60 bits for the given parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("long")


def permute_pair(a: Column, b: Column, m: int, n: int, key: str, kind: str) -> Column:
    """Keyed permutation of (a, b) with 0 <= a < m and 0 <= b < n: an alternating Feistel network."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(acc, i):
        even = i % 2 == 0
        return F.struct(
            F.when(even, (acc["a"] + draw(key, kind, i, acc["b"]) % m) % m).otherwise(acc["a"]).alias("a"),
            F.when(even, acc["b"]).otherwise((acc["b"] + draw(key, kind, i, acc["a"]) % n) % n).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permute_text(s: Column, alphabet: str, key: str, kind: str) -> Column:
    """Keyed permutation of the strings of one length over ``alphabet``: a Feistel network of its halves."""
    n = len(alphabet)

    def shift(half: Column, other: Column, i: Column) -> Column:
        def one(j):
            old = F.instr(F.lit(alphabet), F.substr(half, j, F.lit(1))) - 1
            at = (old + draw(key, kind, i, other, j) % n) % n
            return F.substr(F.lit(alphabet), (at + 1).cast("int"), F.lit(1))

        return F.when(F.length(half) == 0, half).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), one), ""))

    def turn(acc, i):
        even = i % 2 == 0
        return F.struct(
            F.when(even, shift(acc["l"], acc["r"], i)).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(shift(acc["r"], acc["l"], i)).alias("r")
        )

    def halves(v):
        cut = F.floor(F.length(v) / 2).cast("int")
        return F.struct(F.substr(v, F.lit(1), cut).alias("l"), F.substr(v, cut + 1).alias("r"))

    done = let(s, lambda v: F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves(v), turn))
    return let(done, lambda d: F.concat(d["l"], d["r"]))


def refill(form: Column, letters: Column, kind: str) -> Column:
    """``form`` with its characters of class ``kind`` replaced, in order, by ``letters``."""

    def one(v):
        def at(j):
            c = F.substr(v["f"], j, F.lit(1))
            n = F.length(F.regexp_replace(F.substr(v["f"], F.lit(1), j), f"[^{kind}]", ""))
            return F.when(c.rlike(f"[{kind}]"), F.substr(v["l"], n, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(v["f"])), at), "")

    return let(F.struct(form.alias("f"), letters.alias("l")), one)


def only(s: Column, kind: str) -> Column:
    return F.regexp_replace(s, f"[^{kind}]", "")


def luhn_sum(digits: Column, odd_doubled: Column) -> Column:
    """Sum of the digits in which every second one from the right is doubled; ``odd_doubled``: 1 if the last is."""

    def add(acc, j):
        d = F.substr(digits, F.length(digits) - j, F.lit(1)).cast("int")
        d2 = F.when((j + odd_doubled) % 2 == 1, d * 2).otherwise(d)
        return acc + F.when(d2 > 9, d2 - 9).otherwise(d2)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def card(run: Column, key: str) -> Column:
    """(new, n): ``run`` with the numbers of right check digit in it replaced, and how many these are.

    Candidates are all stretches of 13 to 19 digits between edges of groups with
    one mark between the groups, and the whole run. Those in a usual shape go
    first, of an issuer's prefix before others, 16 digits before other lengths, then from
    the left; one that overlaps a better one is left out. The digits before the
    check digit are permuted, then it is set anew. Others stay.
    """

    def pseudonym(d):
        body = permute_text(F.substr(d, F.lit(1), F.length(d) - 1), DIGITS, key, "card")
        return let(body, lambda b: F.concat(b, ((10 - luhn_sum(b, F.lit(1)) % 10) % 10).cast("string")))

    def right(x):
        return let(only(x, "0-9"), lambda d: d.rlike(r"^\d{13,19}$") & ~d.rlike("^(.)\\1*$") & (luhn_sum(d, F.lit(0)) % 10 == 0))

    def candidate(x, first):
        rank = F.when(~x.rlike(SHAPE), F.when(x.contains(" ") & x.contains("-"), 3).otherwise(2)).when(only(x, "0-9").rlike(ISSUER), 0).otherwise(1)
        last = first + F.size(F.split(x, "[ -]")) - 1
        return F.struct(rank.alias("rank"), F.abs(F.length(only(x, "0-9")) - 16).alias("off"), first.alias("first"), last.alias("last"), x.alias("x"))

    def at(groups, i):
        ahead = F.regexp_replace(F.array_join(F.slice(groups, i + 1, 19), ""), "^[ -]", "")
        parts = lambda v: F.array(*[F.regexp_extract(v, rf"^(?:\d(?: ?\d){{{n - 1}}}|\d(?:-?\d){{{n - 1}}})(?!\d)", 0) for n in range(13, 20)])
        return F.transform(F.filter(let(ahead, parts), lambda x: (x != "") & right(x)), lambda x: candidate(x, i))

    def chosen(found):
        apart = lambda acc, c: ~F.exists(acc, lambda a: (c["first"] <= a["last"]) & (a["first"] <= c["last"]))
        best = F.aggregate(F.array_sort(found), F.slice(found, 1, 0), lambda acc, c: F.when(apart(acc, c), F.concat(acc, F.array(c))).otherwise(acc))
        return F.array_sort(F.transform(best, lambda c: F.struct(c["first"].alias("first"), c["last"].alias("last"), c["x"].alias("x"))))

    def rebuilt(groups, numbers):
        begin = F.concat(F.array(F.lit(0)), F.transform(numbers, lambda c: c["last"] + 1))
        end = F.concat(F.transform(numbers, lambda c: c["first"]), F.array(F.size(groups)))
        between = F.zip_with(begin, end, lambda b, e: F.array_join(F.slice(groups, b + 1, e - b), ""))
        new = F.transform(numbers, lambda c: F.struct(F.regexp_extract(groups[c["first"]], "^[ -]?", 0).alias("mark"), c["x"].alias("old"), refill(c["x"], pseudonym(only(c["x"], "0-9")), "0-9").alias("new")))

        def put(v):
            text = F.array_join(F.zip_with(between, v, lambda b, x: F.concat(b, F.coalesce(F.concat(x["mark"], x["new"]), F.lit("")))), "")
            return F.struct(text.alias("new"), F.size(F.filter(v, lambda x: x["old"] != x["new"])).alias("n"))

        return let(new, put)

    def search(groups):
        inner = F.flatten(F.transform(F.sequence(F.lit(0), F.size(groups) - 1), lambda i: at(groups, i)))
        mixed = F.filter(F.array(run), lambda x: x.contains(" ") & x.contains("-") & right(x))
        found = F.concat(inner, F.transform(mixed, lambda x: candidate(x, F.lit(0))))
        return let(found, lambda f: F.when(F.size(f) == 0, F.struct(run.alias("new"), F.lit(0).alias("n"))).otherwise(let(chosen(f), lambda c: rebuilt(groups, c))))

    return let(F.split(run, r"(?<=\d)(?=[ -])", -1), search)


def phone(m: Column, key: str) -> Column:
    """All digits behind the country code, and behind a trunk 0 in parentheses, are permuted."""
    head = F.regexp_extract(m, rf"^(?:\+(?:{CODE}{TRUNK})?)?", 0)
    return let(head, lambda h: let(F.substr(m, F.length(h) + 1), lambda tail: F.concat(h, refill(tail, permute_text(only(tail, "0-9"), DIGITS, key, "phone"), "0-9"))))


def address(m: Column, key: str) -> Column:
    """IPv4 with parts up to 255: the 32 bits are permuted."""
    def new(o):
        p = permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "address")
        return let(p, lambda v: F.concat_ws(".", *[x.cast("string") for x in (F.floor(v["a"] / 256), v["a"] % 256, F.floor(v["b"] / 256), v["b"] % 256)]))

    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    return let(parts, lambda o: F.when(F.forall(o, lambda x: x <= 255), new(o)).otherwise(m))


def social(m: Column, key: str) -> Column:
    """Area 001-899 but 666, group 01-99, serial 0001-9999: permuted among just these."""
    def new(o):
        area = F.when(o[0] > 666, o[0] - 2).otherwise(o[0] - 1)
        p = permute_pair(area * 99 + o[1] - 1, o[2] - 1, 898 * 99, 9999, key, "social")

        def show(v):
            i = F.floor(v["a"] / 99)
            back = F.when(i >= 665, i + 2).otherwise(i + 1)
            return F.concat_ws("-", F.lpad(back.cast("string"), 3, "0"), F.lpad((v["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((v["b"] + 1).cast("string"), 4, "0"))

        return let(p, show)

    ok = lambda o: (o[0] >= 1) & (o[0] <= 899) & (o[0] != 666) & (o[1] >= 1) & (o[2] >= 1)
    return let(F.transform(F.split(m, "-"), lambda x: x.cast("int")), lambda o: F.when(ok(o), new(o)).otherwise(m))


def date(m: Column, key: str) -> Column:
    """Valid days from 1900-01-01 on, 270 * 270 of them (to 2099-08-05): permuted among these, one for both notations."""
    iso = m.contains("-")
    day = F.when(iso, F.try_to_date(m, "yyyy-MM-dd")).otherwise(F.try_to_date(m, "dd/MM/yyyy"))
    first = F.lit("1900-01-01").cast("date")

    def new(n):
        p = permute_pair(F.floor(n / 270), n % 270, 270, 270, key, "date")
        return let(p, lambda v: let(F.date_add(first, (v["a"] * 270 + v["b"]).cast("int")), lambda d: F.when(iso, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "dd/MM/yyyy"))))

    return let(F.date_diff(day, first), lambda n: F.when((n >= 0) & (n < 270 * 270), new(n)).otherwise(m))


def email(m: Column, key: str) -> Column:
    """Letters and digits before the last dot are permuted, in lower case; marks and the top domain stay."""
    low = F.lower(m)
    name, top = F.regexp_extract(low, r"^(.*)(\.[a-z]+)$", 1), F.regexp_extract(low, r"^(.*)(\.[a-z]+)$", 2)
    return F.concat(refill(name, permute_text(only(name, "a-z0-9"), LOWER, key, "email"), "a-z0-9"), top)


def secret(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^(.*?)([0-9a-f]{16,64})$", 1)
    return F.concat(head, permute_text(F.regexp_extract(m, r"^(.*?)([0-9a-f]{16,64})$", 2), HEX, key, "secret"))


def access(m: Column, key: str) -> Column:
    return F.concat(F.lit("AKIA"), permute_text(F.substr(m, F.lit(5)), UPPER, key, "access"))


def whole(pattern: str) -> str:
    # looks behind and ahead at the edges of a whole match see nothing
    return f"^(?:{pattern})$"


def pseudonym(m: Column, key: str) -> Column:
    """(new, n): the pseudonym of a match and the number of values replaced in it."""
    kinds = ((EMAIL, email), (ADDRESS, address), (DATE, date), (SOCIAL, social), (ACCESS, access), (SECRET, secret), (rf"\+.*|{LOCAL}", phone))
    one = functools.reduce(lambda rest, k: F.when(m.rlike(whole(k[0])), k[1](m, key)).otherwise(rest), reversed(kinds), m)
    single = let(one, lambda v: F.struct(v.alias("new"), F.when(v != m, 1).otherwise(0).alias("n")))
    return F.when(m.rlike(r"^\d[\d -]{11,}\d$"), card(m, key)).otherwise(single)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the personal values in ``text_col`` replaced by pseudonyms of the same format.

    Card numbers with a right check digit, phone numbers, social security
    numbers, dates, IPv4 addresses, e-mail addresses and keys are validated and
    permuted within their format under ``key``: each value has one pseudonym,
    whatever document or notation it stands in, and no two values share one.
    What is not valid stays as it is. Null stays null; a text without values is
    unchanged. ``count_col``: the number of values replaced (0 for null); a
    column of that name in the table gives way to it.
    One pass, no shuffle.
    """
    text = F.col(f"`{text_col}`").cast("string")
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    parts, hit = F.split(text, ANY, -1), text.rlike(ANY)

    def put(c):
        joined = F.array_join(F.zip_with(parts, c, lambda p, m: F.concat(p, F.coalesce(m["new"], F.lit("")))), "")
        return F.struct(joined.alias("text"), F.aggregate(c, F.lit(0), lambda n, m: n + m["n"]).alias("n"))

    new = F.transform(found, lambda m: pseudonym(m, key))
    if count_col is None:
        return docs.withColumn(text_col, F.when(hit, let(new, put)["text"]).otherwise(text))
    # one struct, so that pseudonyms are worked out once for both columns
    none = F.struct(text.alias("text"), F.lit(0).alias("n"))
    (own,) = free_names(docs, "__both")
    both = F.explode(F.array(F.when(hit, let(new, put)).otherwise(none))).alias(own)
    rest = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.select(*rest, both)
    return out.withColumns({text_col: F.col(f"{own}.text"), count_col: F.col(f"{own}.n").cast("long")}).drop(own)
