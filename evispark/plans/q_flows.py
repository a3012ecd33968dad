"""Catalogue: the five retrieve-and-answer dataflows with offline models."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from evispark.operators import dense, flows
from evispark.plans import corpus, sql
from evispark.plans.q_retrieval import small
from evispark.plans.registry import query
from evispark.plans.sql import compose, cte, ranked
from evispark.session import settle, spread


def prepared(spark, sf):
    """Chunks and questions of the flows; the chunk vectors are settled once,
    because every round searches them again."""
    q = corpus.questions(spark, sf).select("qid", "tenant", "text")
    c = spread(corpus.chunks(spark, sf)).withColumn("chunk_id", corpus.chunk_name())
    return q, c, flows.FlowConfig(small=small(spark, sf), citation=r"\b([A-Z]{2,3}-\d{5,})\b")


def retriever(chunks, k, reuse=False):
    if not reuse:
        return lambda q: dense.hashing_top_k(chunks, q, k)
    vectors = settle(dense.hashing_vectors(chunks, "doc_id"))
    return lambda q: dense.vector_top_k(vectors, dense.hashing_vectors(q, "qid"), 384, k)


def tidy(df):
    return df.select(
        "qid", "answer", F.array_join("citations", ",").alias("citations"), "refused", "generator_calls",
        F.round("cost_usd", 6).alias("cost_usd"), "n_in_context", "tokens_in", "tokens_out",
    )


def flow_ctes(name: str, hits: str, reranked: bool) -> None:
    """CTEs reproducing one single-call flow over the ranked CTE ``hits``."""
    qd = f"list_distinct({sql.query_terms('q.text')})"
    score = f"round(len(list_intersect({qd}, {sql.toks('c.text')})) / greatest(len({qd}), 1)::DOUBLE, 9)" if reranked else "0"
    block = (
        "'[' || " + sql.CHUNK_NAME.replace("tenant", "h.tenant").replace("doc_id", "h.doc_id")
        + " || ' | p.' || c.page_number || ']' || chr(10) || c.text"
    )
    cte(
        f"{name}_ranked", (hits, "chunks", "questions"),
        f"""SELECT * FROM (SELECT qid, chunk_id, block, row_number() OVER (PARTITION BY qid ORDER BY s DESC, prior) AS rank
          FROM (SELECT h.qid, {sql.CHUNK_NAME.replace('tenant', 'h.tenant').replace('doc_id', 'h.doc_id')} AS chunk_id, {block} AS block, {score} AS s, h.rank AS prior
            FROM {hits} h JOIN chunks c ON c.doc_id = h.doc_id JOIN questions q ON q.qid = h.qid)) WHERE rank <= 10""",
    )
    cte(
        f"{name}_ctx", (f"{name}_ranked",),
        f"""SELECT qid, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context, list(chunk_id ORDER BY rank) AS supplied FROM (
          SELECT *, sum(t) OVER (PARTITION BY qid ORDER BY rank) AS run FROM (SELECT *, {sql.tokens_of('block')} AS t FROM {name}_ranked))
          WHERE rank = 1 OR run <= 2200 GROUP BY qid""",
    )
    prompt = (
        "'Passages:' || chr(10) || CASE WHEN trim(coalesce(context, '')) <> '' THEN trim(context) ELSE 'NO_CONTEXT' END || chr(10) || chr(10) "
        "|| 'Asked: ' || q.text || chr(10) || chr(10) || 'Answer from the passages and name their ids in brackets.'"
    )
    head = "\\[([A-Z]{2,3}-\\d{5,})[^\\]]*\\]\\n([^\\n]+)"
    cte(
        f"{name}_said", (f"{name}_ctx", "questions"),
        f"""SELECT *, CASE WHEN contains(prompt, 'NO_CONTEXT') OR regexp_extract(prompt, '{head}', 1) = '' THEN '{flows.T.REFUSAL_TEXT}'
          ELSE trim('The first passage says this (' || regexp_extract(prompt, '{head}', 1) || '): '
            || substr(regexp_extract(prompt, '{head}', 2), 1, 240)) END AS answer
        FROM (SELECT q.qid, coalesce(supplied, []) AS supplied, {prompt} AS prompt FROM questions q LEFT JOIN {name}_ctx USING (qid))""",
    )


def flow_sql(name: str) -> str:
    return compose(
        f"""SELECT qid, answer, array_to_string(list_filter(list_distinct(regexp_extract_all(answer, '\\b([A-Z]{{2,3}}-\\d{{5,}})\\b', 1)), lambda c: list_contains(supplied, c)), ',') AS citations,
        {sql.any_of('answer', flows.T.REFUSAL_MARKERS)} AS refused, 1 AS generator_calls, 0.0::DOUBLE AS cost_usd, len(supplied)::INT AS n_in_context,
        {sql.tokens_of("('" + flows.SYSTEM_PROMPT + "' || prompt)")} AS tokens_in, {sql.tokens_of('answer')} AS tokens_out FROM {name}_said""",
        f"{name}_said",
    )


ranked("dense_25", "dense", 25)
flow_ctes("simple", "dense_10", False)
flow_ctes("reranked", "dense_25", True)


@query("flow_simple", flow_sql("simple"))
def flow_simple(spark, sf):
    q, c, cfg = prepared(spark, sf)
    return tidy(flows.simple(q, c, retriever(c, cfg.top_k), cfg))


@query("flow_reranked", flow_sql("reranked"))
def flow_reranked(spark, sf):
    q, c, cfg = prepared(spark, sf)
    return tidy(flows.reranked(q, c, retriever(c, cfg.overfetch), cfg))


# --- flows of several calls: models that answer JSON from a hash of their prompt ---


def answer_sql(context: str, text: str) -> str:
    return (
        f"'Passages:' || chr(10) || CASE WHEN trim(coalesce({context}, '')) <> '' THEN trim({context}) ELSE 'NO_CONTEXT' END || chr(10) || chr(10) "
        f"|| 'Asked: ' || {text} || chr(10) || chr(10) || 'Answer from the passages and name their ids in brackets.'"
    )


def mock_sql(prompt: str) -> str:
    head = "\\[([A-Z]{2,3}-\\d{5,})[^\\]]*\\]\\n([^\\n]+)"
    return (
        f"CASE WHEN contains({prompt}, 'NO_CONTEXT') OR regexp_extract({prompt}, '{head}', 1) = '' THEN '{flows.T.REFUSAL_TEXT}' "
        f"ELSE trim('The first passage says this (' || regexp_extract({prompt}, '{head}', 1) || '): ' || substr(regexp_extract({prompt}, '{head}', 2), 1, 240)) END"
    )


def metered(prompt: str, reply: str) -> tuple[str, str]:
    return sql.tokens_of("('" + flows.SYSTEM_PROMPT + "' || " + prompt + ")"), sql.tokens_of(reply)


def searched(name: str, asked: str, before: str, turn: int) -> None:
    """CTEs of one more search: ``asked`` (qid, tenant, text) over the chunks, its hits behind those of ``before``, reranked and packed."""
    sql.hashed(f"{name}_vec", asked, "qid")
    cte(
        f"{name}_dense", ("d_vec", f"{name}_vec", "chunks", asked),
        f"""SELECT p.qid, p.tenant, p.doc_id, coalesce(s.score, 0.0) AS score FROM (SELECT q.qid, q.tenant, c.doc_id FROM {asked} q JOIN chunks c USING (tenant)) p
        LEFT JOIN (SELECT q.qid, d.doc_id, sum(q.v * d.v) AS score FROM {name}_vec q JOIN d_vec d ON d.tenant = q.tenant AND d.bucket = q.bucket GROUP BY ALL) s ON s.qid = p.qid AND s.doc_id = p.doc_id""",
    )
    ranked(f"{name}_25", f"{name}_dense", 25)
    cte(
        f"{name}_pool", (before, f"{name}_25"),
        f"SELECT qid, tenant, doc_id, min(struct_pack(t := turn, r := rank)) AS place FROM (SELECT qid, tenant, doc_id, 1 AS turn, rank FROM {before} UNION ALL SELECT qid, tenant, doc_id, {turn}, rank FROM {name}_25) GROUP BY ALL",
    )
    cte(f"{name}_hits", (f"{name}_pool",), f"SELECT qid, tenant, doc_id, row_number() OVER (PARTITION BY qid ORDER BY place) AS rank FROM {name}_pool")
    flow_ctes(name, f"{name}_hits", True)


def by_hash(prompt, *replies):
    """One of ``replies`` by the first digit of the prompt's md5."""
    at = F.conv(F.substring(F.md5(prompt.cast("binary")), 1, 1), 16, 10).cast("int") % len(replies)
    return F.element_at(F.array(*[r if not isinstance(r, str) else F.lit(r) for r in replies]), at + 1)


def by_hash_sql(prompt: str, *replies: str) -> str:
    return f"[{', '.join(replies)}][(('0x' || substr(md5({prompt}), 1, 1))::INT % {len(replies)}) + 1]"


FIRST_WORDS = r"following\?\n(\S+ \S+ \S+)"


def json_critic(prompt):
    words = F.regexp_extract(prompt, FIRST_WORDS, 1)
    refined = F.concat(F.lit('Sure: {"sufficient": false, "refined_query": "'), words, F.lit('"} so far'))
    return by_hash(prompt, '{"sufficient": true}', refined, '{"sufficient": false}', "no JSON at all")


def json_reflection(prompt):
    return by_hash(prompt, '{"is_supported": true, "needs_more_retrieval": false}', '{"is_supported": false}', '{"needs_more_retrieval": true}', "none")


def critic_sql(context: str) -> str:
    return (
        f"'Passages found so far:' || chr(10) || CASE WHEN coalesce({context}, '') <> '' THEN {context} ELSE 'NONE' END || chr(10) || chr(10) || 'Do they answer the following?' || chr(10) || q.text "
        "|| chr(10) || 'Reply with one JSON object: sufficient (boolean) and, if not, refined_query.'"
    )


def verdicts(name: str, context: str, rows: str) -> None:
    """CTE ``name``: the critic's prompt, reply and verdict for each question of ``rows`` over the contexts ``context``."""
    refined = f"'Sure: {{\"sufficient\": false, \"refined_query\": \"' || regexp_extract(prompt, '{FIRST_WORDS}', 1) || '\"}} so far'"
    reply = by_hash_sql("prompt", "'{\"sufficient\": true}'", refined, "'{\"sufficient\": false}'", "'no JSON at all'")
    cte(
        name, (context, rows),
        f"""SELECT *, j IS NULL OR coalesce((j->>'$.sufficient')::BOOLEAN, FALSE) AS enough, trim(coalesce(j->>'$.refined_query', '')) AS refined FROM (
          SELECT *, CASE WHEN contains(reply, '{{') THEN regexp_extract(reply, '([{{].*[}}])', 1)::JSON END AS j FROM (
            SELECT *, {reply} AS reply FROM (SELECT q.qid, q.tenant, q.text, c.context, coalesce(c.supplied, []) AS supplied, {critic_sql('c.context')} AS prompt FROM {rows} q LEFT JOIN {context} c USING (qid))))""",
    )


def told_sql(said: str) -> str:
    """Answer columns of ``said`` (qid, supplied, prompt, answer, calls, tin, tout): the last call added to what was spent before."""
    tin, tout = metered("prompt", "answer")
    return (
        "SELECT qid, answer, array_to_string(list_filter(list_distinct(regexp_extract_all(answer, '\\b([A-Z]{2,3}-\\d{5,})\\b', 1)), lambda c: list_contains(supplied, c)), ',') AS citations, "
        f"{sql.any_of('answer', flows.T.REFUSAL_MARKERS)} AS refused, (calls + 1)::INT AS generator_calls, 0.0::DOUBLE AS cost_usd, len(supplied)::INT AS n_in_context, "
        f"(tin + {tin})::BIGINT AS tokens_in, (tout + {tout})::BIGINT AS tokens_out FROM {said}"
    )


verdicts("ag1", "reranked_ctx", "questions")
cte("ag_live", ("ag1",), "SELECT qid, tenant, text AS asked, CASE WHEN j IS NULL OR refined = '' THEN trim(text) ELSE refined END AS text FROM ag1 WHERE NOT enough")
searched("ag2", "ag_live", "dense_25", 2)
cte("ag_again", ("ag_live",), "SELECT qid, tenant, asked AS text FROM ag_live")
verdicts("ag2v", "ag2_ctx", "ag_again")
cte(
    "ag_said", ("ag1", "ag2v"),
    f"""SELECT *, {mock_sql('prompt')} AS answer FROM (
      SELECT qid, supplied, {answer_sql('context', 'text')} AS prompt, 1 AS calls, {metered('prompt', 'reply')[0]} AS tin, {metered('prompt', 'reply')[1]} AS tout FROM ag1 WHERE enough
      UNION ALL SELECT b.qid, b.supplied, {answer_sql('b.context', 'b.text')}, 2, {metered('a.prompt', 'a.reply')[0]} + {metered('b.prompt', 'b.reply')[0]}, {metered('a.prompt', 'a.reply')[1]} + {metered('b.prompt', 'b.reply')[1]}
        FROM ag2v b JOIN ag1 a USING (qid))""",
)


@query("flow_agentic_json", compose(told_sql("ag_said"), "ag_said"))
def flow_agentic_json(spark, sf):
    """Two rounds at most, with a critic whose verdict is JSON, JSON among words, or none."""
    q, c, cfg = prepared(spark, sf)
    cfg = replace(cfg, agentic_calls=(2, 3))
    return tidy(flows.agentic(q, c, retriever(c, cfg.overfetch, True), cfg, critic=json_critic))


cte(
    "sr_said", ("reranked_said", "reranked_ctx", "questions"),
    f"""SELECT *, {by_hash_sql('reflected', "'{\"is_supported\": true, \"needs_more_retrieval\": false}'", "'{\"is_supported\": false}'", "'{\"needs_more_retrieval\": true}'", "'none'")} AS reply FROM (
      SELECT s.qid, s.supplied, s.prompt, s.answer, 'Passages:' || chr(10) || CASE WHEN coalesce(c.context, '') <> '' THEN c.context ELSE 'NONE' END || chr(10) || chr(10) || 'Asked:' || chr(10) || q.text
        || chr(10) || chr(10) || 'Answered:' || chr(10) || s.answer || chr(10) || chr(10) || 'Reply with one JSON object: is_supported and needs_more_retrieval (booleans).' AS reflected
      FROM reranked_said s JOIN questions q USING (qid) LEFT JOIN reranked_ctx c USING (qid))""",
)
cte(
    "sr_spent", ("sr_said",),
    f"""SELECT qid, supplied, prompt, answer, CASE WHEN wider THEN 2 ELSE 1 END AS calls, {metered('reflected', 'reply')[0]} + CASE WHEN wider THEN {metered('prompt', 'answer')[0]} ELSE 0 END AS tin,
    {metered('reflected', 'reply')[1]} + CASE WHEN wider THEN {metered('prompt', 'answer')[1]} ELSE 0 END AS tout FROM (
      SELECT *, reply = 'none' OR coalesce((CASE WHEN reply <> 'none' THEN reply::JSON END->>'$.needs_more_retrieval')::BOOLEAN, FALSE) OR NOT coalesce((CASE WHEN reply <> 'none' THEN reply::JSON END->>'$.is_supported')::BOOLEAN, TRUE) AS wider FROM sr_said)""",
)


@query("flow_self_reflect_json", compose(told_sql("sr_spent"), "sr_spent"))
def flow_self_reflect_json(spark, sf):
    """A reflection in JSON decides who searches again; the wider search of a question without topics is the same one."""
    q, c, cfg = prepared(spark, sf)
    return tidy(flows.self_reflect(q, c, retriever(c, cfg.overfetch, True), cfg, reflect=json_reflection))


UNSURE = lambda x: sql.any_of(x, flows.T.LOW_CONFIDENCE_MARKERS)
cte("la_first", ("reranked_said", "questions"), "SELECT q.qid, q.tenant, q.text AS asked, s.prompt, s.answer, q.text || ' ' || substr(s.answer, 1, 300) AS text FROM reranked_said s JOIN questions q USING (qid)")
searched("la2", "la_first", "dense_25", 2)
cte(
    "la_second", ("la_first", "la2_said"),
    f"""SELECT f.qid, f.tenant, f.asked, s.supplied, s.prompt, s.answer, 1 AS calls, {metered('f.prompt', 'f.answer')[0]} AS tin, {metered('f.prompt', 'f.answer')[1]} AS tout,
    f.asked || ' ' || substr(s.answer, 1, 300) AS text, {UNSURE('s.answer')} AS unsure FROM la_first f JOIN la2_said s USING (qid)""",
)
cte("la_open", ("la_second",), "SELECT qid, tenant, text FROM la_second WHERE unsure")
searched("la3", "la_open", "la2_hits", 3)
cte(
    "la_said", ("la_second", "la3_said"),
    f"""SELECT qid, supplied, prompt, answer, calls, tin, tout FROM la_second WHERE NOT unsure UNION ALL
    SELECT a.qid, s.supplied, s.prompt, s.answer, 2, a.tin + {metered('a.prompt', 'a.answer')[0]}, a.tout + {metered('a.prompt', 'a.answer')[1]} FROM la_second a JOIN la3_said s USING (qid) WHERE a.unsure""",
)


# A mock critic never answers JSON: the search is repeated once, with the same question, and then counts as sufficient.
cte(
    "am_said", ("reranked_said", "reranked_ctx", "questions"),
    f"""SELECT qid, supplied, prompt, answer, 2 AS calls, 2 * {metered('asked', 'reply')[0]} AS tin, 2 * {metered('asked', 'reply')[1]} AS tout FROM (
      SELECT *, {mock_sql('asked')} AS reply FROM (SELECT q.qid, s.supplied, s.prompt, s.answer, {critic_sql('c.context')} AS asked FROM reranked_said s JOIN questions q USING (qid) LEFT JOIN reranked_ctx c USING (qid)))""",
)
cte(
    "sm_said", ("sr_said",),
    f"""SELECT qid, supplied, prompt, answer, 2 AS calls, {metered('reflected', 'mocked')[0]} + {metered('prompt', 'answer')[0]} AS tin, {metered('reflected', 'mocked')[1]} + {metered('prompt', 'answer')[1]} AS tout
    FROM (SELECT * EXCLUDE reply, {mock_sql('reflected')} AS mocked FROM sr_said)""",
)


@query("flow_agentic", compose(told_sql("am_said"), "am_said"))
def flow_agentic(spark, sf):
    q, c, cfg = prepared(spark, sf)
    return tidy(flows.agentic(q, c, retriever(c, cfg.overfetch, True), cfg))


@query("flow_self_reflect", compose(told_sql("sm_said"), "sm_said"))
def flow_self_reflect(spark, sf):
    q, c, cfg = prepared(spark, sf)
    return tidy(flows.self_reflect(q, c, retriever(c, cfg.overfetch, True), cfg))


@query("flow_lookahead", compose(told_sql("la_said"), "la_said"))
def flow_lookahead(spark, sf):
    q, c, cfg = prepared(spark, sf)
    return tidy(flows.lookahead(q, c, retriever(c, cfg.overfetch, True), cfg))
