"""Explicit schemas; readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


# --- fixed values -----------------------------------------------------------
# Field names of the input files.
MANIFEST = (
    "corpus string, corpus_version string, source_pdf string, source_sha256 string, n_chunks int, "
    "embed_model string, embed_dim int, n_paragraphs int, target_tokens int, overlap_tokens int"
)
CHUNK = (
    "chunk_id string, corpus string, text string, page_number int, section string, document_name string, "
    "metadata struct<pages: array<int>>"
)
QUESTION = (
    "qid string, question string, reference_answer string, answerable boolean, category string, difficulty string, "
    "expected_pages array<int>, expected_sections array<string>, requires_table boolean, requires_image boolean, "
    "requires_multi_section boolean, corpus string, source_set string, curation_note string"
)
BENCHMARK = (
    "benchmark_id string, counts struct<total: int, answerable: int, negative_or_control: int, with_expected_pages: int>, "
    f"questions array<struct<{', '.join(f.replace(' ', ': ', 1) for f in QUESTION.split(', '))}>>"
)
QUESTION_CSV = (
    "qid string, utility string, category string, difficulty int, topic string, topic2 string, question string, "
    "is_negative string, is_table string, is_image string"
)
# Keys that would leak the evaluation into a corpus.
FORBIDDEN_FIELDS = (
    "question", "questions", "answer", "answers", "reference_answer", "expected_answer", "gold_answer",
    "gold_evidence", "qid",
)
# --- end of fixed values ----------------------------------------------------
