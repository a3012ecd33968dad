"""Strict and lenient JSON parsing of judge output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evispark.functions.arrays import let

# --- fixed values: the judge document ---------------------------------------
SCHEMA_VERSION = "1.0"
SCORES = ("correctness", "completeness", "groundedness", "citation_quality")
KEYS = frozenset(
    ("schema_version", "evaluation_id", "response_disposition", "explanation", *SCORES)
)
DISPOSITIONS = ("substantive_answer", "refusal")
# --- end of fixed values ----------------------------------------------------

def single_object(raw: Column) -> Column:
    """VARIANT of a text that is one JSON document and nothing else, else NULL.

    The parser stops behind the first document, so the text is parsed as the
    one element of an array and as the first of two; what trails it breaks one.
    Repeated keys and numbers that are not finite are no JSON to it.
    """
    body = F.trim(F.regexp_replace(raw, r"\s+$|^\s+", ""))
    one = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))), "$", "array<variant>")
    two = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), body, F.lit(",0]"))), "$", "array<variant>")
    return F.when((F.size(one) == 1) & (F.size(two) == 2), one[0])


def parse_judge(raw, evaluation_id, answerable, version: str = SCHEMA_VERSION) -> Column:
    """Struct of a judge reply: valid, error, disposition, scores, explanation.

    The document is described, field by field, by the JSON kinds and values it
    may have; ``error`` names the first field that is not so, or ``document``.
    Nothing is coerced, and an invalid reply yields no values.
    """
    raw, ident, answerable = (F.col(c) if isinstance(c, str) else c for c in (raw, evaluation_id, answerable))

    def described(v):
        def kind(name):
            return F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), F.lit("VOID"))

        def text(name):
            return F.when(kind(name) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))

        def score(name):
            return F.when(kind(name) == "BIGINT", F.try_variant_get(v, f"$.{name}", "int"))

        graded = F.coalesce(answerable, F.lit(False)) & text("response_disposition").eqNullSafe(F.lit("substantive_answer"))
        said = F.trim(F.regexp_replace(text("explanation"), r"^\s+|\s+$", ""))
        right = {
            "schema_version": text("schema_version") == version,
            "evaluation_id": text("evaluation_id") == ident,
            "response_disposition": text("response_disposition").isin(*DISPOSITIONS),
            **{n: F.when(graded, score(n).between(1, 5)).otherwise(kind(n) == "VOID") for n in SCORES},
            "explanation": (F.length(said) > 0) & (F.length(text("explanation")) <= 1000),
        }
        names = F.json_object_keys(F.trim(raw))
        whole = v.isNotNull() & F.coalesce(F.array_sort(names) == F.array(*[F.lit(k) for k in sorted(KEYS)]), F.lit(False))
        wrong = F.when(~whole, F.lit("document"))
        for name, ok in right.items():
            wrong = F.coalesce(wrong, F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)))

        def result(e):
            def only(c):
                return F.when(e.isNull(), c)

            return F.struct(
                e.isNull().alias("valid"), e.alias("error"), only(text("response_disposition")).alias("response_disposition"),
                *[only(score(n)).alias(n) for n in SCORES], only(said).alias("explanation"),
            )

        return let(wrong, result)

    return let(single_object(raw), described)


def lenient_object(text: Column) -> Column:
    """VARIANT of the first ``{`` to the last ``}``, NULL if that is no JSON."""
    return F.try_parse_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1))


def key_report(raw: Column, keys=KEYS) -> Column:
    """Struct of the keys that a JSON object lacks (missing) and has beyond ``keys`` (extra), both sorted; null if it is no single object."""
    names = F.when(single_object(raw).isNotNull(), F.array_distinct(F.json_object_keys(F.trim(raw))))
    due = F.array(*[F.lit(k) for k in sorted(keys)])
    return F.when(names.isNotNull(), F.struct(F.array_sort(F.array_except(due, names)).alias("missing"), F.array_sort(F.array_except(names, due)).alias("extra")))
