"""SQL twins: named common table expressions and a small composer."""

from __future__ import annotations

from evispark.functions import numeric
from evispark.functions import text as T


def lst(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def fold(x: str) -> str:
    return f"replace(replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ'), 'ſ', 's')"


def toks(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, '[\\p{{L}}\\p{{N}}]+')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{T.SPACE}'), lambda w: w <> '')"


def tokens_of(x: str) -> str:
    return f"(floor(len({words(x)}) * 1.3::DOUBLE) + 1)::INT"


def query_terms(x: str) -> str:
    kept = f"list_filter({toks(x)}, lambda t: NOT list_contains({lst(T.STOP_WORDS)}, t))"
    return f"(CASE WHEN len({kept}) > 0 THEN {kept} ELSE {toks(x)} END)"


def audit_terms(x: str) -> str:
    return (
        f"list_distinct(list_filter({toks(x)}, lambda t: NOT list_contains({lst(T.AUDIT_STOP_WORDS)}, t) AND length(t) > 1))"
    )


def any_of(x: str, markers) -> str:
    return "(" + " OR ".join("contains(lower(%s), '%s')" % (x, m.replace("'", "''")) for m in markers) + ")"


CHUNK_NAME = "upper(tenant) || '-' || lpad(doc_id::VARCHAR, greatest(5, length(doc_id::VARCHAR))::INT, '0')"

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], body: str) -> None:
    CTES[name] = (needs, body)


def compose(select: str, *needs: str, extra: dict | None = None) -> str:
    """WITH-clause of everything ``needs`` pulls in, then ``select``."""
    done: list[str] = []
    defs = dict(CTES)
    defs.update(extra or {})

    def visit(n):
        if n in done:
            return
        for d in defs[n][0]:
            visit(d)
        done.append(n)

    for n in needs:
        visit(n)
    parts = ",\n".join(f"{n} AS MATERIALIZED ({defs[n][1]})" for n in done)
    return f"WITH RECURSIVE {parts}\n{select}"


cte(
    "questions", (),
    "SELECT t.tenant || '-' || b.item_id AS qid, t.tenant, b.item_id, b.text "
    "FROM benchmark b, (SELECT DISTINCT lang AS tenant FROM documents WHERE lang IS NOT NULL) t",
)
cte(
    "chunks", (),
    "SELECT doc_id, lang AS tenant, source, 'vol-' || doc_id // 50 AS document, text, (doc_id // 4 + 1)::INT AS page_number, "
    "CASE WHEN doc_id % 4 = 3 THEN [(doc_id // 4 + 1)::INT, (doc_id // 4 + 2)::INT] "
    "ELSE [(doc_id // 4 + 1)::INT] END AS pages FROM documents",
)
cte("doc_tok", ("chunks",), f"SELECT tenant, doc_id, unnest({toks('text')}) AS term FROM chunks")
cte("tf_plain", ("doc_tok",), "SELECT tenant, doc_id, term, count(*)::DOUBLE AS tf FROM doc_tok GROUP BY ALL")
cte(
    "dl_plain", ("chunks", "doc_tok"),
    "SELECT c.tenant, c.doc_id, count(d.term)::DOUBLE AS dl FROM chunks c "
    "LEFT JOIN doc_tok d USING (tenant, doc_id) GROUP BY ALL",
)
cte("q_term", ("questions",),
    f"SELECT qid, tenant, term, count(*) AS qf FROM (SELECT qid, tenant, unnest({query_terms('text')}) AS term "
    "FROM questions) GROUP BY ALL")
cte(
    "gold", ("questions", "chunks"),
    "SELECT q.qid, q.tenant, q.item_id, c.doc_id, c.page_number FROM questions q "
    "JOIN chunks c ON c.tenant = q.tenant AND contains(c.text, q.text)",
)
cte("expected", ("gold",), "SELECT DISTINCT qid, page_number AS page FROM gold")


def bm25(name: str, tf: str, dl: str) -> None:
    """Scores CTE ``name`` (qid, tenant, doc_id, score) over given tf and dl."""
    cte(
        name, (tf, dl, "q_term"),
        f"""SELECT q.qid, q.tenant, t.doc_id,
            sum(q.qf * ln(1.0::DOUBLE + (s.n - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE))
                * t.tf * 2.2::DOUBLE / (t.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d.dl / s.avgdl))) AS score
        FROM q_term q
        JOIN {tf} t ON t.tenant = q.tenant AND t.term = q.term
        JOIN (SELECT tenant, term, count(*) AS df FROM {tf} GROUP BY ALL) f ON f.tenant = q.tenant AND f.term = q.term
        JOIN {dl} d ON d.tenant = t.tenant AND d.doc_id = t.doc_id
        JOIN (SELECT tenant, count(*) AS n, CASE WHEN avg(dl) <= 0 THEN 1.0 ELSE avg(dl) END AS avgdl
              FROM {dl} GROUP BY ALL) s ON s.tenant = q.tenant
        GROUP BY ALL""",
    )


def ranked(name: str, scores: str, k: int, extra_order: str = "") -> None:
    cte(
        name, (scores,),
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, "
        f"{extra_order}doc_id) AS rank FROM {scores}) WHERE rank <= {k}",
    )


bm25("bm25", "tf_plain", "dl_plain")
ranked("bm25_10", "bm25", 10)


def md5_mod(x: str, m: int) -> str:
    acc = "0::BIGINT"
    for i in range(4):
        acc = f"(({acc}) * 4294967296 + ('0x' || substr(md5({x}), {1 + 8 * i}, 8))::BIGINT) % {m}"
    return acc


def draw(n: str, *key: str) -> str:
    parts = " || '|' || ".join(f"({k})::VARCHAR" for k in key)
    return f"(('0x' || substr(md5({parts}), 1, 8))::BIGINT % {n})"


def mix32(rows: str, keep: str) -> str:
    """Rows (keep, h) with h, a number below 2 ** 32, mixed."""
    word = "4294967296::UBIGINT"
    once = f"SELECT {keep}, (xor(h, h >> 16) * {numeric.MIX_1}::UBIGINT) % {word} AS h FROM ({rows})"
    twice = f"SELECT {keep}, (xor(h, h >> 13) * {numeric.MIX_2}::UBIGINT) % {word} AS h FROM ({once})"
    return f"SELECT {keep}, xor(h, h >> 16) AS h FROM ({twice})"


def drawn(clusters: str, keys: tuple[str, ...], repetitions: int, seed: int, width: int) -> str:
    """(keys, rep, m): mean of each repetition over CTE ``clusters`` (keys, i, s, n), drawn in two levels."""
    k = "".join(f"{c}, " for c in keys)
    by = lambda a, b: " AND ".join(["TRUE", *[f"{a}.{c} = {b}.{c}" for c in keys]])
    step = f"{numeric.STRIDE}::UBIGINT"
    begin = lambda rows, keep: mix32(
        f"SELECT {keep}, xor(h, part) AS h FROM ({mix32(f'SELECT {keep}, ({seed}::UBIGINT + rep::UBIGINT * {step}) % 4294967296::UBIGINT AS h FROM ({rows})', keep)})", keep
    )
    spread = lambda rows, keep, most: mix32(f"SELECT {keep}, (h + j::UBIGINT * {step}) % 4294967296::UBIGINT AS h FROM (SELECT *, unnest(range({most})) AS j FROM ({rows}))", keep)
    sizes = f"SELECT {k}count(*) AS size FROM {clusters}" + (f" GROUP BY {k[:-2]}" if keys else "")
    blocks = f"SELECT {k}i // {width} AS b, count(*) AS size FROM {clusters} GROUP BY ALL"
    level1 = begin(f"SELECT {k}size, rep, 0::UBIGINT AS part FROM ({sizes}), generate_series(0, {repetitions - 1}) t(rep)", f"{k}size, rep, part")
    fell = f"SELECT {k}rep, ((h * size::UBIGINT) >> 32)::BIGINT // {width} AS b, count(*) AS hits FROM ({spread(level1, f'{k}size, rep', 'size')}) GROUP BY ALL"
    asked = f"SELECT f.*, z.size, (f.b + 1)::UBIGINT AS part FROM ({fell}) f JOIN ({blocks}) z ON z.b = f.b AND {by('f', 'z')}"
    level2 = begin(asked, f"{k}size, rep, b, hits, part")
    taken = f"SELECT {k}rep, b * {width} + ((h * size::UBIGINT) >> 32)::BIGINT AS i FROM ({spread(level2, f'{k}size, rep, b', 'hits')})"
    return f"SELECT {''.join(f't.{c}, ' for c in keys)}t.rep, sum(c.s) / sum(c.n) AS m FROM ({taken}) t JOIN {clusters} c ON c.i = t.i AND {by('t', 'c')} GROUP BY ALL"


def normal_p(z: str) -> str:
    """Two-sided tail of the normal distribution: one minus the error function, by its series of positive terms."""
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    terms = f"list_sum(list_transform(range(0, 400), lambda i: exp(2 * i * ln(2.0::DOUBLE) + lgamma(i + 1) - lgamma(2 * i + 2) + (2 * i + 1) * ln({x}))))"
    return f"CASE WHEN {z} = 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * {terms}) END"


def wilcoxon(name: str, keys: str, pairs: str) -> None:
    """CTE ``name`` (keys, n_nonzero, w_plus, z, p, p_exact, method) of the CTE ``pairs`` (keys, difference)."""
    same = lambda a, b: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))
    cte(
        f"{name}_ranks", (pairs,),
        f"""SELECT {keys}, d, c, rk, row_number() OVER (PARTITION BY {keys} ORDER BY abs(d)) AS i, (2 * rk)::BIGINT AS r, count(*) OVER (PARTITION BY {keys}) AS n
        FROM (SELECT {keys}, d, rank() OVER (PARTITION BY {keys} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {keys}, abs(d)) - 1) / 2.0::DOUBLE AS rk,
          count(*) OVER (PARTITION BY {keys}, abs(d)) AS c FROM (SELECT {keys}, round(difference, 12) AS d FROM {pairs}) WHERE d <> 0)""",
    )
    # Numbers of sign choices for each doubled rank sum, one rank a round.
    cte(
        f"{name}_walk", (f"{name}_ranks",),
        f"""SELECT {keys}, 0::BIGINT AS i, [1::BIGINT] AS ways FROM (SELECT DISTINCT {keys} FROM {name}_ranks WHERE n <= 50)
        UNION ALL
        SELECT {', '.join('w.' + k.strip() for k in keys.split(','))}, x.i, list_transform(range(1, len(w.ways) + x.r + 1),
          lambda j: coalesce(w.ways[j], 0) + CASE WHEN j > x.r THEN w.ways[j - x.r] ELSE 0 END)
        FROM {name}_walk w JOIN {name}_ranks x ON {same('w', 'x')} AND x.i = w.i + 1""",
    )
    cte(
        name, (f"{name}_ranks", f"{name}_walk", pairs),
        f"""SELECT *, CASE WHEN method = 'exact' THEN p_exact ELSE {normal_p('z')} END AS p FROM (
          SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, coalesce(s.n_nonzero, 0) AS n_nonzero, coalesce(s.w_plus, 0.0) AS w_plus, coalesce(s.z, 0.0) AS z,
            CASE WHEN w.ways IS NOT NULL THEN least(1.0::DOUBLE, 2 * least(list_sum(w.ways[1:(2 * s.w_plus)::BIGINT + 1]), list_sum(w.ways[(2 * s.w_plus)::BIGINT + 1:])) / list_sum(w.ways)::DOUBLE) END AS p_exact,
            CASE WHEN s.n_nonzero <= 50 AND s.most = 1 AND a.n = s.n_nonzero THEN 'exact' ELSE 'normal' END AS method
          FROM (SELECT {keys}, count(difference) AS n FROM {pairs} GROUP BY ALL) a
          LEFT JOIN (SELECT {keys}, count(*) AS n_nonzero, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w_plus, max(c) AS most,
            CASE WHEN count(*) * (count(*) + 1.0::DOUBLE) * (2 * count(*) + 1) / 24 - sum(c * c - 1) / 48.0::DOUBLE > 0 THEN
              (sum(CASE WHEN d > 0 THEN rk ELSE 0 END) - count(*) * (count(*) + 1) / 4.0::DOUBLE)
              / sqrt(count(*) * (count(*) + 1.0::DOUBLE) * (2 * count(*) + 1) / 24 - sum(c * c - 1) / 48.0::DOUBLE) ELSE 0.0 END AS z
            FROM {name}_ranks GROUP BY {keys}) s ON {same('a', 's')}
          LEFT JOIN {name}_walk w ON {same('a', 'w')} AND w.i = s.n_nonzero)""",
    )


def holm(tests: str, family: str, label: str) -> str:
    """``tests`` with p_holm, stepping down within each family."""
    return f"""SELECT *, max(least(1.0::DOUBLE, (m - rn + 1) * p)) OVER (PARTITION BY {family} ORDER BY rn) AS p_holm FROM (
      SELECT *, count(*) OVER (PARTITION BY {family}) AS m, row_number() OVER (PARTITION BY {family} ORDER BY round(p, 12), {label}) AS rn FROM ({tests}))"""


def hashed(name: str, src: str, ident: str) -> None:
    cte(
        name, (src,),
        f"""SELECT {ident}, tenant, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {ident})) AS v FROM (
          SELECT {ident}, tenant, {md5_mod('w', 384)} AS bucket, count(*)::DOUBLE AS n
          FROM (SELECT {ident}, tenant, unnest({words('lower(text)')}) AS w FROM {src}) GROUP BY ALL)""",
    )


hashed("d_vec", "chunks", "doc_id")
hashed("q_vec", "questions", "qid")
cte(
    "dense", ("d_vec", "q_vec", "chunks", "questions"),
    """SELECT p.qid, p.tenant, p.doc_id, coalesce(s.score, 0.0) AS score
    FROM (SELECT q.qid, q.tenant, c.doc_id FROM questions q JOIN chunks c USING (tenant)) p
    LEFT JOIN (SELECT q.qid, d.doc_id, sum(q.v * d.v) AS score FROM q_vec q
               JOIN d_vec d ON d.tenant = q.tenant AND d.bucket = q.bucket GROUP BY ALL) s
      ON s.qid = p.qid AND s.doc_id = p.doc_id""",
)
ranked("dense_10", "dense", 10)
ranked("dense_50", "dense", 50)
ranked("bm25_50", "bm25", 50)
ranked("bm25_40", "bm25", 40)

cte(
    "tf_weighted", ("chunks",),
    "SELECT tenant, doc_id, term, sum(w) AS tf FROM ("
    f"SELECT tenant, doc_id, unnest({toks('text')}) AS term, 1.0::DOUBLE AS w FROM chunks UNION ALL "
    f"SELECT tenant, doc_id, unnest({toks('split_part(text, chr(10), 1)')}), 3.0::DOUBLE FROM chunks UNION ALL "
    f"SELECT tenant, doc_id, unnest({toks('source')}), 2.5::DOUBLE FROM chunks) GROUP BY ALL",
)
cte(
    "dl_weighted", ("chunks", "tf_weighted"),
    "SELECT c.tenant, c.doc_id, coalesce(sum(t.tf), 0.0) AS dl FROM chunks c "
    "LEFT JOIN tf_weighted t USING (tenant, doc_id) GROUP BY ALL",
)
bm25("bm25w", "tf_weighted", "dl_weighted")
ranked("bm25w_10", "bm25w", 10)
ranked("bm25w_25", "bm25w", 25)
ranked("bm25w_40", "bm25w", 40)

cte(
    "chain", ("chunks",),
    """SELECT tenant, doc_id, document,
      CASE WHEN lag(document) OVER w = document THEN lag(doc_id) OVER w END AS prev_id,
      CASE WHEN lead(document) OVER w = document THEN lead(doc_id) OVER w END AS next_id
    FROM chunks WINDOW w AS (PARTITION BY tenant ORDER BY doc_id)""",
)
cte(
    "edges", ("chain",),
    "SELECT tenant, doc_id AS src, prev_id AS dst FROM chain WHERE prev_id IS NOT NULL UNION "
    "SELECT tenant, doc_id, next_id FROM chain WHERE next_id IS NOT NULL",
)


def expanded(name: str, seeds: str) -> None:
    """One-hop expansion CTE of the seeds CTE (qid, tenant, doc_id, score)."""
    cte(
        name, (seeds, "edges"),
        f"""SELECT qid, tenant, doc_id, max(gain) AS link_score, 1 AS link_depth,
          list_sort(list_distinct(list(seed) FILTER (gain >= top * (1 - 1e-12::DOUBLE)))) AS seed_ids
        FROM (SELECT s.qid, s.tenant, e.dst AS doc_id, s.doc_id AS seed,
                greatest(0.0::DOUBLE, s.score) * 0.35::DOUBLE AS gain,
                max(greatest(0.0::DOUBLE, s.score) * 0.35::DOUBLE) OVER (PARTITION BY s.qid, e.dst) AS top
              FROM {seeds} s JOIN edges e ON e.tenant = s.tenant AND e.src = s.doc_id
              WHERE NOT EXISTS (SELECT 1 FROM {seeds} o WHERE o.qid = s.qid AND o.doc_id = e.dst))
        GROUP BY ALL""",
    )


def native(name: str, scores: str, seed_k: int, k: int) -> None:
    ranked(f"{name}_seeds", scores, seed_k)
    expanded(f"{name}_links", f"{name}_seeds")
    cte(
        f"{name}_all", (f"{name}_seeds", f"{name}_links", scores),
        f"""SELECT qid, tenant, doc_id, score, 0 AS link_depth, [doc_id] AS seed_ids FROM {name}_seeds UNION ALL
        SELECT l.qid, l.tenant, l.doc_id, greatest(coalesce(s.score, 0.0), l.link_score), l.link_depth, l.seed_ids
        FROM {name}_links l LEFT JOIN {scores} s ON s.qid = l.qid AND s.doc_id = l.doc_id""",
    )
    ranked(name, f"{name}_all", k, "link_depth, ")


native("native_10", "bm25w", 5, 10)
native("native_40", "bm25w", 20, 40)
native("evidence_10", "bm25", 5, 10)
ranked("hybrid_seeds", "dense", 5)
expanded("hybrid_links", "hybrid_seeds")
cte(
    "hybrid_all", ("hybrid_seeds", "hybrid_links"),
    "SELECT qid, tenant, doc_id, score, 0 AS link_depth, [doc_id] AS seed_ids FROM hybrid_seeds UNION ALL "
    "SELECT qid, tenant, doc_id, link_score, link_depth, seed_ids FROM hybrid_links",
)
ranked("hybrid_10", "hybrid_all", 10, "link_depth, ")


def adjacent(name: str, ranked_cte: str, seeds: int, k: int) -> None:
    cte(
        f"{name}_all", (ranked_cte, "chunks"),
        f"""SELECT qid, tenant, doc_id, score, 0 AS link_depth FROM {ranked_cte} WHERE rank <= {seeds} UNION ALL
        SELECT s.qid, s.tenant, c.doc_id, greatest(0.0::DOUBLE, arg_min(s.score, s.rank * 2 + x.d)) * 0.35::DOUBLE, 1
        FROM {ranked_cte} s, (VALUES (-1), (1)) x(d), chunks c
        WHERE s.rank <= {seeds} AND c.tenant = s.tenant AND c.doc_id = s.doc_id + x.d
          AND NOT EXISTS (SELECT 1 FROM {ranked_cte} o WHERE o.qid = s.qid AND o.rank <= {seeds} AND o.doc_id = c.doc_id)
        GROUP BY s.qid, s.tenant, c.doc_id""",
    )
    ranked(name, f"{name}_all", k)


adjacent("adjacent_10", "bm25_10", 5, 10)


def fused(name: str, arms: tuple[str, ...], k: int) -> None:
    union = " UNION ALL ".join(f"SELECT qid, tenant, doc_id, rank FROM {a}" for a in arms)
    cte(
        f"{name}_all", arms,
        f"SELECT qid, tenant, doc_id, sum(1.0::DOUBLE / (60.0::DOUBLE + rank)) AS score, count(*)::INT AS n_arms "
        f"FROM ({union}) GROUP BY ALL",
    )
    ranked(name, f"{name}_all", k)


fused("rrf_10", ("bm25_50", "dense_50"), 10)
fused("rrf3_25", ("dense_50", "bm25_50", "bm25w_25"), 25)
fused("rrf_40", ("dense_40", "native_40"), 40)
ranked("dense_40", "dense", 40)
