"""Text expressions. Everything here is a Column and stays on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evispark.functions.arrays import let

# --- fixed values -----------------------------------------------------------
# Query stop words.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or",
    "that", "the", "this", "to", "was", "were", "what", "when", "where", "which", "who", "with",
]

# Stop words of the gold audit, a second and different list.
AUDIT_STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "or",
    "that", "the", "this", "to", "was", "were", "what", "which", "with",
]

# Phrases that mark an answer as a refusal.
REFUSAL_MARKERS = [
    "does not contain sufficient information",
    "not contain sufficient information",
    "cannot answer",
    "can't answer",
    "no information",
    "not found in",
    "not covered",
    "unable to answer",
    "not addressed in",
    "not mentioned in",
    "i don't have",
    "i do not have",
    "outside the scope",
    "not in the provided context",
]

# Refusal phrases of the judging stage.
JUDGE_REFUSAL_MARKERS = [
    "does not contain sufficient information",
    "cannot answer",
    "can't answer",
    "no information",
    "not found in",
    "not covered",
    "unable to answer",
    "not addressed in",
    "not mentioned in",
    "outside the scope",
    "not in the provided context",
]

# Hedges; "may " keeps its trailing blank.
LOW_CONFIDENCE_MARKERS = [
    "does not contain sufficient",
    "not contain sufficient",
    "unclear",
    "might",
    "may ",
    "possibly",
    "not sure",
    "cannot",
    "no information",
]

# Patterns of the release scan.
SECRET_PATTERNS = {
    "aws_access_key_id": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "aws_secret_assignment": r"(?i)AWS_SECRET_ACCESS_KEY\s*=",
    "aws_session_assignment": r"(?i)AWS_SESSION_TOKEN\s*=",
    "bedrock_api_assignment": r"(?i)(?:AWS_BEARER_TOKEN_BEDROCK|BEDROCK[-_]API[-_]KEY)\s*=",
    "openai_key_assignment": r"(?i)OPENAI_API_KEY\s*=",
    "github_token": r"\b(?:ghp_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,})\b",
    "aws_arn": r"\barn:aws(?:-[a-z]+)?:[A-Za-z0-9_./:=+@-]+",
    "absolute_macos_home": r"/Users/[^/\s]+/",
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
}

REFUSAL_TEXT = "The retrieved context does not contain sufficient information to answer this."
# --- end of fixed values ----------------------------------------------------

WORD = r"([\p{L}\p{N}]+)"
# Unicode white space, spelled so that Java and RE2 read it alike.
SPACE = (
    r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
CITATION = r"\b([A-Z]{2,3}-\d{5})\b"


def casefold(text: Column) -> Column:
    """Lower case plus the foldings lower() leaves out."""
    out = F.lower(text)
    for old, new in (("ß", "ss"), ("ς", "σ"), ("ſ", "s")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def tokens(text: Column) -> Column:
    """Maximal runs of letters and digits of the case-folded text."""
    return F.regexp_extract_all(casefold(text), F.lit(WORD), 1)


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 1)


def _literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def query_terms(text: Column) -> Column:
    """Tokens without stop words, unless nothing else is left."""
    toks = tokens(text)
    kept = F.filter(toks, lambda t: ~t.isin(STOP_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(toks)


def audit_terms(text: Column) -> Column:
    return F.array_distinct(
        F.filter(tokens(text), lambda t: ~t.isin(AUDIT_STOP_WORDS) & (F.length(t) > 1))
    )


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def has_words(text: Column) -> Column:
    """Whether `words` finds any, without cutting the text."""
    return F.coalesce(text.rlike("[^" + SPACE[1:-1]), F.lit(False))


def token_count(text: Column) -> Column:
    """Approximate model tokens: floor(words * 1.3) + 1, and 1 for empty text.

    The separator is greedy, so only the ends of the split can be empty.
    """
    empty_ends = lambda a: (F.get(a, F.lit(0)) == "").cast("int") + (F.element_at(a, -1) == "").cast("int")
    n = let(F.split(text, SPACE), lambda a: F.greatest(F.size(a) - empty_ends(a), F.lit(0)))
    return (F.floor(n * F.lit(1.3)) + 1).cast("int")


def contains_any(text: Column, markers) -> Column:
    """Whether the lowered text holds one of the phrases."""
    low = F.lower(text)
    hit = F.lit(False)
    for marker in markers:
        hit = hit | F.contains(low, F.lit(marker))
    return hit


def refused(text: Column) -> Column:
    return contains_any(text, REFUSAL_MARKERS)


def refused_judge(text: Column) -> Column:
    return contains_any(casefold(text), JUDGE_REFUSAL_MARKERS)


def low_confidence(text: Column) -> Column:
    return contains_any(text, LOW_CONFIDENCE_MARKERS)


# Latin letters whose compatibility decomposition starts with an ASCII letter;
# the combining marks of already decomposed text are dropped as non-ASCII.
_ACCENTED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"


def _plain_letters() -> str:
    import unicodedata

    return "".join(unicodedata.normalize("NFKD", c)[0] for c in _ACCENTED)


def ascii_fold(text: Column) -> Column:
    """Lower case, accents removed, every other non-ASCII character dropped."""
    low = F.translate(F.lower(F.regexp_replace(text, SPACE, " ")), _ACCENTED, _plain_letters())
    return F.regexp_replace(low, r"[^\x00-\x7F]", "")


def slug(text: Column) -> Column:
    """Path-safe name; a digest prefix stands in when nothing is left."""
    body = F.regexp_replace(F.regexp_replace(ascii_fold(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(body != "", body).otherwise(F.concat(F.lit("id-"), F.substring(F.sha2(text, 256), 1, 12)))


def topic_slug(text: Column, limit: int = 72) -> Column:
    body = F.regexp_replace(F.regexp_replace(ascii_fold(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(body, 1, limit), "-+$", "")
    return F.when(cut != "", cut).otherwise(F.lit("topic"))


def page_label(pages: Column) -> Column:
    joined = F.array_join(pages.cast("array<string>"), ", ")
    return (
        F.when(F.size(pages) <= 0, F.lit("page not recorded"))
        .when(F.size(pages) == 1, F.concat(F.lit("page "), joined))
        .otherwise(F.concat(F.lit("pages "), joined))
    )


def passage_title(chunk_id: Column, section: Column, pages: Column) -> Column:
    named = F.trim(section)
    return F.concat(
        chunk_id,
        F.lit(" — "),
        F.when(F.coalesce(named, F.lit("")) != "", named).otherwise(F.initcap(page_label(pages))),
    )


def passage_description(chunk_id: Column, document: Column, pages: Column) -> Column:
    return F.concat(
        F.lit("Source chunk "), chunk_id, F.lit(" from "), document, F.lit(", "), page_label(pages), F.lit(".")
    )


def percent_encode(text: Column) -> Column:
    """Percent-encoding that keeps ``-._~`` and writes a blank as %20."""
    enc = F.url_encode(text)
    for old, new in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        enc = F.replace(enc, F.lit(old), F.lit(new))
    return enc


def chunk_urn(source_sha: Column, chunk_id: Column) -> Column:
    return F.concat(F.lit("urn:sha256:"), F.lower(source_sha), F.lit("#chunk="), percent_encode(chunk_id))


def pages_urn(source_sha: Column, pages: Column) -> Column:
    tail = F.when(
        F.size(pages) > 0, F.concat(F.lit("pages="), F.array_join(pages.cast("array<string>"), ","))
    ).otherwise(F.lit("document"))
    return F.concat(F.lit("urn:sha256:"), F.lower(source_sha), F.lit("#"), tail)


def id_ordinal(chunk_id: Column) -> Column:
    """Number after the last dash; NULL when the suffix is not a number."""
    tail = F.substring_index(chunk_id, "-", -1)
    return F.when(tail.rlike("^[0-9]+$"), F.try_to_number(tail, F.lit("9" * 18)).cast("bigint"))


def citations(answer: Column, supplied: Column, pattern: str = CITATION) -> Column:
    """Distinct ids cited in the answer that were in the supplied context."""
    found = F.regexp_extract_all(answer, F.lit(pattern), 1)
    return F.array_distinct(F.filter(found, lambda c: F.array_contains(supplied, c)))


def to_bool(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("true", "1", "yes")


def section_number(title: Column) -> Column:
    found = F.regexp_extract(title, r"^(\d+(?:\.\d+)*)\.?\s+(.*)$", 1)
    return F.when(found != "", found)


def section_references(text: Column) -> Column:
    """Section numbers of two or more levels mentioned in running text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\bSections?\s+(\d+(?:\.\d+)+)"), 1))


def secret_names(text: Column) -> Column:
    """Names of the scan patterns found in the text."""
    return F.array_compact(
        F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in SECRET_PATTERNS.items()])
    )


def context_header(chunk_id: Column, page: Column) -> Column:
    return F.concat(
        F.lit("["),
        chunk_id,
        F.coalesce(F.concat(F.lit(" | p."), page.cast("string")), F.lit("")),
        F.lit("]"),
    )


def answer_prompt(question: Column, context: Column) -> Column:
    """Answer prompt; an empty context becomes the NO_CONTEXT sentinel."""
    ctx = F.when(F.trim(context) != "", F.trim(context)).otherwise(F.lit("NO_CONTEXT"))
    return F.concat(
        F.lit("Passages:\n"), ctx, F.lit("\n\nAsked: "), question,
        F.lit("\n\nAnswer from the passages and name their ids in brackets."),
    )


def format_percent(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%.1f%%", x * 100.0))


def format_interval(mean: Column, low: Column, high: Column) -> Column:
    return F.format_string("%+.3f [%+.3f, %+.3f]", mean, low, high)


def format_p(p: Column) -> Column:
    return (
        F.when(p.isNull(), F.lit("n/a"))
        .when(p < 0.001, F.lit("< 0.001"))
        .otherwise(F.format_string("%.3f", p))
    )


def iso_date(text: Column) -> Column:
    """DATE of a strict yyyy-MM-dd text, else NULL."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def utc_timestamp(text: Column) -> Column:
    """Whole seconds in UTC with a Z; NULL without an explicit time zone.

    The session time zone must be UTC.
    """
    zoned = text.rlike(r"T.*(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, F.date_format(text.try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
