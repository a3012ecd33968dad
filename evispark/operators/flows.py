"""Five retrieve-and-answer dataflows as set-based steps over all questions.

A retriever is ``f(questions) -> (qid, tenant, doc_id, score, rank)`` and a
generator ``f(df, prompt_column) -> Column`` over batches of prompts. Loops are
unrolled to the call cap over the questions still open; the state of a round
(one row a question with the sums of its model calls, and its candidate pool)
is settled through the checkpoint folder, so no model is asked twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.functions import jsonx, numeric
from evispark.functions import text as T
from evispark.operators import fusion, packing
from evispark.session import broadcast_if, settle


@dataclass(frozen=True)
class FlowConfig:
    """Defaults of every flow."""

    top_k: int = 10
    overfetch: int = 25
    budget: int = 2200
    model: str = "mock"
    agentic_calls: tuple[int, int] = (3, 8)
    reflect_calls: int = 4
    lookahead_calls: int = 3
    lookahead_chars: int = 300
    citation: str = T.CITATION
    small: bool = False  # the questions' size was checked


SYSTEM_PROMPT = (
    "Answer using ONLY the retrieved context provided. Cite sources using the bracketed chunk id and page. "
    "If the context does not contain enough information, say so."
)

Retriever = Callable[[DataFrame], DataFrame]


def mock_answer(prompt: Column) -> Column:
    """Offline generator: cites the first context block and echoes 240 characters."""
    head = r"\[([A-Z]{2,3}-\d{5,})[^\]]*\]\n([^\n]+)"
    cid = F.regexp_extract(prompt, head, 1)
    said = F.concat(
        F.lit("The first passage says this ("), cid, F.lit("): "),
        F.substring(F.regexp_extract(prompt, head, 2), 1, 240),
    )
    empty = F.contains(prompt, F.lit("NO_CONTEXT")) | (cid == "")
    return F.when(empty, F.lit(T.REFUSAL_TEXT)).otherwise(F.trim(said))


def ranked_context(hits: DataFrame, questions: DataFrame, chunks: DataFrame, cfg: FlowConfig, rerank: bool) -> tuple[DataFrame, DataFrame]:
    """(packed rows, one context row a question) from ranked candidates."""
    body = chunks.select("tenant", "doc_id", "chunk_id", "page_number", "pages", "text")
    rows = body.join(broadcast_if(hits.select("qid", "tenant", "doc_id", "score", "rank"), cfg.small), ["tenant", "doc_id"])
    if rerank:
        asked = questions.select("qid", F.col("text").alias("question"))
        rows = rows.join(broadcast_if(asked, cfg.small), "qid")
        rows = fusion.rerank(rows, cfg.top_k, fusion.overlap(F.col("question"), F.col("text"))).drop("question")
    else:
        rows = rows.filter(F.col("rank") <= cfg.top_k)
    packed = packing.pack_prefix(packing.context_blocks(rows), cfg.budget)
    return packed, packing.context_text(packed)


def spent(prompt: Column, reply: Column, model: str, before: Column | None = None, system: str = SYSTEM_PROMPT) -> Column:
    """Struct of calls, tokens_in, tokens_out and cost after one more call."""
    tin, tout = T.token_count(F.concat(F.lit(system), prompt)), T.token_count(reply)
    cost = numeric.usage_cost(F.lit(model), tin, tout)
    if before is None:
        return F.struct(F.lit(1).alias("calls"), tin.alias("tokens_in"), tout.alias("tokens_out"), cost.alias("cost"))
    return F.struct(
        (before["calls"] + 1).alias("calls"), (before["tokens_in"] + tin).alias("tokens_in"),
        (before["tokens_out"] + tout).alias("tokens_out"), (before["cost"] + cost).alias("cost"),
    )


def with_context(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    q = questions.drop("context", "supplied").join(contexts.select("qid", "context", "supplied"), "qid", "left")
    return q.withColumns({"context": F.coalesce("context", F.lit("")), "supplied": F.coalesce("supplied", F.array().cast("array<string>"))})


def answered(rows: DataFrame, cfg: FlowConfig, generate, before: Column | None = None) -> DataFrame:
    """Adds ``answer`` and the running sums ``spent`` of one generator call over ``context``."""
    prompt = T.answer_prompt(F.col("text"), F.col("context"))
    said = rows.withColumn("answer", generate(prompt))
    return said.withColumn("spent", spent(prompt, F.col("answer"), cfg.model, before))


def answer_records(rows: DataFrame, cfg: FlowConfig, flow: str) -> DataFrame:
    """One record a question: its answer, citations in the context, and the sums over all model calls."""
    return rows.select(
        F.lit(flow).alias("flow"), "qid", "tenant", "answer", T.citations(F.col("answer"), F.col("supplied"), cfg.citation).alias("citations"),
        T.refused(F.col("answer")).alias("refused"), F.col("spent.calls").alias("generator_calls"),
        F.bround("spent.cost", 8).alias("cost_usd"), F.size("supplied").alias("n_in_context"),
        F.col("spent.tokens_in").alias("tokens_in"), F.col("spent.tokens_out").alias("tokens_out"),
    )


def simple(questions: DataFrame, chunks: DataFrame, retrieve: Retriever, cfg: FlowConfig = FlowConfig(), generate=mock_answer) -> DataFrame:
    """Retrieve, pack, answer: one call."""
    _, ctx = ranked_context(retrieve(questions), questions, chunks, cfg, rerank=False)
    return answer_records(answered(with_context(questions, ctx), cfg, generate), cfg, "simple")


def reranked(questions: DataFrame, chunks: DataFrame, retrieve: Retriever, cfg: FlowConfig = FlowConfig(), generate=mock_answer) -> DataFrame:
    """Over-fetch, rerank, pack, answer: one call."""
    _, ctx = ranked_context(retrieve(questions), questions, chunks, cfg, rerank=True)
    return answer_records(answered(with_context(questions, ctx), cfg, generate), cfg, "reranked")


def _pooled(pool: DataFrame | None, hits: DataFrame, turn: int) -> DataFrame:
    """Candidate pool; the first occurrence of a passage keeps its place."""
    new = hits.select("qid", "tenant", "doc_id", "score", F.lit(turn).alias("turn"), "rank")
    rows = new if pool is None else pool.unionByName(new)
    return rows.groupBy("qid", "tenant", "doc_id").agg(
        F.min_by(F.struct("score", "turn", "rank"), F.struct("turn", "rank")).alias("_f")
    ).select("qid", "tenant", "doc_id", "_f.score", "_f.turn", "_f.rank")


def _in_order(pool: DataFrame) -> DataFrame:
    """Pool rows ranked by arrival, the prior order of a rerank."""
    from pyspark.sql import Window

    w = Window.partitionBy("qid").orderBy("turn", "rank")
    return pool.select("qid", "tenant", "doc_id", "score", F.row_number().over(w).alias("rank"))


def _extended(questions: DataFrame, *more: str) -> Column:
    """The question with those of the columns ``more`` that there are."""
    return F.trim(F.concat_ws(" ", F.col("text"), *[F.col(c) for c in more if c in questions.columns]))


def critic_prompt(question: Column, context: Column) -> Column:
    ctx = F.when(context != "", context).otherwise(F.lit("NONE"))
    return F.concat(
        F.lit("Passages found so far:\n"), ctx, F.lit("\n\nDo they answer the following?\n"), question,
        F.lit("\nReply with one JSON object: sufficient (boolean) and, if not, refined_query."),
    )


def agentic(questions: DataFrame, chunks: DataFrame, retrieve: Retriever, cfg: FlowConfig = FlowConfig(),
            generate=mock_answer, critic: Callable[[Column], Column] | None = None) -> DataFrame:
    """Retrieve, pool, rerank, ask a critic, rewrite, until sufficient; then answer.

    A critic reply that is no JSON counts as sufficient from round min-1 on;
    before that the search goes on with the question, its topic and its
    utility. A reply without a rewrite searches question and topic. Only
    questions still open are searched, judged and metered.
    """
    low, high = cfg.agentic_calls
    need, rounds = max(1, low - 1), max(1, high - 1)
    critic = critic or mock_answer
    nothing = F.struct(F.lit(0).alias("calls"), F.lit(0).cast("bigint").alias("tokens_in"), F.lit(0).cast("bigint").alias("tokens_out"), F.lit(0.0).alias("cost"))
    live = questions.withColumns({"query": F.col("text"), "spent": nothing})
    pool, done = None, []
    for i in range(1, rounds + 1):
        pool = settle(_pooled(pool, retrieve(live.select("qid", "tenant", F.col("query").alias("text"))), i))
        _, ctx = ranked_context(_in_order(pool), questions, chunks, cfg, rerank=True)
        prompt = critic_prompt(F.col("text"), F.col("context"))
        judged = settle(with_context(live, ctx).withColumn("_reply", critic(prompt)).withColumn("spent", _summed(spent(prompt, F.col("_reply"), cfg.model, F.col("spent")))))
        verdict = judged.withColumn("_v", jsonx.lenient_object(F.col("_reply")))
        refined = F.trim(F.coalesce(F.try_variant_get("_v", "$.refined_query", "string"), F.lit("")))
        parsed = F.coalesce(F.try_variant_get("_v", "$.sufficient", "boolean"), F.lit(False))
        enough = (F.col("_v").isNull() | parsed) & F.lit(i >= need)
        rewrite = F.when(F.col("_v").isNull(), _extended(questions, "topic", "utility")).when(refined != "", refined).otherwise(_extended(questions, "topic"))
        step = verdict.withColumns({"_enough": enough | F.lit(i == rounds), "query": rewrite})
        done.append(step.filter("_enough").select(*questions.columns, "context", "supplied", "spent"))
        live = step.filter("not _enough").select(*questions.columns, "query", "spent")
        if i == rounds or live.isEmpty():
            break
    rows = done[0]
    for d in done[1:]:
        rows = rows.unionByName(d)
    return answer_records(answered(rows, cfg, generate, F.col("spent")), cfg, "agentic")


def _summed(s: Column) -> Column:
    return F.struct(s["calls"].cast("int").alias("calls"), s["tokens_in"].cast("bigint").alias("tokens_in"), s["tokens_out"].cast("bigint").alias("tokens_out"), s["cost"].cast("double").alias("cost"))


def reflect_prompt(question: Column, context: Column, answer: Column) -> Column:
    ctx = F.when(context != "", context).otherwise(F.lit("NONE"))
    return F.concat(
        F.lit("Passages:\n"), ctx, F.lit("\n\nAsked:\n"), question, F.lit("\n\nAnswered:\n"), answer,
        F.lit("\n\nReply with one JSON object: is_supported and needs_more_retrieval (booleans)."),
    )


def self_reflect(questions: DataFrame, chunks: DataFrame, retrieve: Retriever, cfg: FlowConfig = FlowConfig(),
                 generate=mock_answer, reflect: Callable[[Column], Column] | None = None) -> DataFrame:
    """Draft, reflect, and when unsupported search wider once and revise.

    A draft that is supported is the answer. With one call allowed there is no
    reflection, with two no revision.
    """
    reflect = reflect or mock_answer
    pool = settle(_pooled(None, retrieve(questions), 1))
    _, ctx = ranked_context(_in_order(pool), questions, chunks, cfg, rerank=True)
    draft = answered(with_context(questions, ctx), cfg, generate)
    if cfg.reflect_calls < 2:
        return answer_records(draft, cfg, "self_reflect")
    prompt = reflect_prompt(F.col("text"), F.col("context"), F.col("answer"))
    seen = draft.withColumn("_reply", reflect(prompt))
    seen = settle(seen.withColumn("spent", _summed(spent(prompt, F.col("_reply"), cfg.model, F.col("spent"))))).withColumn("_v", jsonx.lenient_object(F.col("_reply")))
    more = F.try_variant_get("_v", "$.needs_more_retrieval", "boolean")
    supported = F.try_variant_get("_v", "$.is_supported", "boolean")
    wider = F.when(F.col("_v").isNull(), F.lit(True)).otherwise(F.coalesce(more, F.lit(False)) | ~F.coalesce(supported, F.lit(True)))
    state = settle(seen.withColumn("_wider", wider & F.lit(cfg.reflect_calls > 2)).drop("_v", "_reply"))
    again = state.filter("_wider")
    pool = settle(_pooled(pool, retrieve(again.select("qid", "tenant", _extended(questions, "topic", "topic2").alias("text"))), 2))
    _, ctx = ranked_context(_in_order(pool), questions, chunks, cfg, rerank=True)
    revised = answered(with_context(again, ctx), cfg, generate, F.col("spent"))
    columns = [*questions.columns, "context", "supplied", "answer", "spent"]
    both = state.filter("not _wider").select(*columns).unionByName(revised.select(*columns))
    return answer_records(both, cfg, "self_reflect")


def lookahead(questions: DataFrame, chunks: DataFrame, retrieve: Retriever, cfg: FlowConfig = FlowConfig(), generate=mock_answer) -> DataFrame:
    """Draft, search with question and draft, regenerate until confident; the confident answer is returned."""
    pool = settle(_pooled(None, retrieve(questions), 1))
    _, ctx = ranked_context(_in_order(pool), questions, chunks, cfg, rerank=True)
    first = answered(with_context(questions, ctx), cfg, generate)
    live = settle(first.withColumn("spent", _summed(F.col("spent"))))
    done = []
    for turn in range(2, cfg.lookahead_calls + 1):
        ahead = F.concat_ws(" ", F.col("text"), F.substring("answer", 1, cfg.lookahead_chars))
        pool = settle(_pooled(pool, retrieve(live.select("qid", "tenant", ahead.alias("text"))), turn))
        _, ctx = ranked_context(_in_order(pool), questions, chunks, cfg, rerank=True)
        nxt = answered(with_context(live.drop("answer"), ctx), cfg, generate, F.col("spent"))
        nxt = settle(nxt.withColumn("spent", _summed(F.col("spent"))).withColumn("_unsure", T.low_confidence(F.col("answer"))))
        done.append(nxt.filter("not _unsure").drop("_unsure"))
        live = nxt.filter("_unsure").drop("_unsure")
        if live.isEmpty():
            break
    rows = live
    for d in done:
        rows = rows.unionByName(d)
    return answer_records(rows, cfg, "lookahead")


FLOWS = {"simple": simple, "reranked": reranked, "agentic": agentic, "self_reflect": self_reflect, "lookahead": lookahead}
