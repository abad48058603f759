"""Check queries: seeds, context, retrieval modes, page answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hybrid, merge as mg, postings as ps, vectors as vx
from ..session import cut
from . import answer as an, inputs
from .catalog import pages, questions, register, with_views
from .check_graph import MERGED, REPORT_JSON, COMMUNITIES, _ADJ, _spread_ctes, _sql, communities_v, entities, relationships
from .check_search import bm25_ctes, cos_cte, embed_ctes, postings_ctes, _index, _page_vectors

# Questions that name things of the graph: one per customer segment and nation.
ASKED = """
SELECT n_nationkey AS question_id, concat('which parts does nation ', lower(n_name), ' supply, and is ', p.p_name, ' one? ',
       CASE WHEN n_nationkey % 5 = 0 THEN 'Give an overview.' ELSE '' END) AS text
FROM nation JOIN (SELECT p_partkey, p_name FROM part) p ON p.p_partkey = n_nationkey * 3"""

# Text units: one per order line, with the part and the supplier in it.
UNITS = """SELECT l_orderkey * 100 + l_linenumber AS text_unit_id, concat('raw/', l_orderkey, '.md') AS page_path, l_linenumber AS chunk_index,
  concat('line ', l_linenumber, ' of order ', l_orderkey) AS text, l_partkey, l_suppkey FROM (
    SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber) x"""
LINKS = """SELECT text_unit_id, l_partkey AS entity_id FROM units_t UNION ALL SELECT text_unit_id, 10000000 + l_suppkey FROM units_t"""
CLAIMS = """SELECT text_unit_id AS claim_id, l_partkey AS subject_id, 10000000 + l_suppkey AS object_id, 'TRUE' AS status, 'LINK' AS type,
  concat('delivered with ', page_path) AS description FROM units_t"""

_EIDX = postings_ctes("entities_v", "entity_id", "title", "description")
_EE = embed_ctes("de", "entities_v", "entity_id", "concat(title, chr(10), description)")
_QE = embed_ctes("qe", "questions_v", "question_id", "text")

SEED = {
    "questions_v": ASKED, **_EIDX, **_EE, **_QE,
    "cand": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS r0 FROM scored) r WHERE r0 <= 20""",
    "ccos": cos_cte("cand"),
    "mixed": """SELECT question_id, doc_id, round(0.45 * score / CASE WHEN top = 0 THEN 1.0 ELSE top END + 0.55 * greatest(coalesce(cosine, 0.0), 0.0), 6) AS score
                FROM (SELECT *, max(score) OVER (PARTITION BY question_id) AS top FROM cand) c LEFT JOIN ccos USING (question_id, doc_id)""",
    "seeded": """SELECT question_id, doc_id AS entity_id, score AS value, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank
                 FROM mixed) r WHERE rank <= 5""",
}


def asked(spark, sf):
    return _sql(spark, sf, ASKED)


def graph(spark, sf, with_reports=True):
    e = cut(entities(spark, sf))
    units_t = cut(_sql(spark, sf, UNITS))
    units_t.createOrReplaceTempView("units_t")
    postings, stats = an.entity_index(e)
    vectors = cut(vx.hash_embed(e.select("entity_id", F.concat_ws("\n", "title", "description").alias("text")), "entity_id", "text"))
    return an.Graph(
        entities=e, relationships=relationships(spark, sf),
        units=units_t.select("text_unit_id", "page_path", "chunk_index", "text"),
        text_unit_entities=cut(spark.sql(LINKS)), claims=cut(spark.sql(CLAIMS)), postings=postings, stats=cut(stats),
        entity_vectors=vectors, reports=reports(spark, sf) if with_reports else None,
    )


def reports(spark, sf):
    from ..operators.reports import parse_reports

    a = communities_v(spark, sf).select("level", "cluster").distinct().withColumn("response", F.expr(REPORT_JSON))
    return cut(parse_reports(a))


@register("seed_entities", with_views("entities_v", **SEED) + "SELECT question_id, entity_id, value, rank FROM seeded")
def seed_entities(spark, sf):
    return an.seed_entities(asked(spark, sf), graph(spark, sf, False))


_SPREAD_SEED = {k: v for k, v in {**_ADJ, **_spread_ctes("seeded")}.items() if k != "seeds"}
_TOP10 = {
    **_SPREAD_SEED,
    "top10": """SELECT question_id, entity_id, activation, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY activation DESC, entity_id) AS rank
                FROM spreaded) x WHERE rank <= 10""",
}
_CONTEXT = {
    "units_t": UNITS, "tue": LINKS, "claims_t": CLAIMS,
    "clines": """
      SELECT question_id, 0 AS block, row_number() OVER (PARTITION BY question_id ORDER BY entity_id) AS nth, concat('Entity: ', title, ' (', type, ') -- ', description) AS line
      FROM {wanted} JOIN entities_v USING (entity_id)
      UNION ALL SELECT question_id, 1, nth, concat('Text unit (', page_path, '#', chunk_index, '): ', text) FROM (
        SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY page_path, chunk_index) AS nth FROM (
          SELECT DISTINCT question_id, text_unit_id, page_path, chunk_index, text FROM {wanted} JOIN tue USING (entity_id) JOIN units_t USING (text_unit_id)) a) b WHERE nth <= 10
      UNION ALL SELECT question_id, 2, nth, concat('Claim (', status, ', ', type, '): ', description) FROM (
        SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY claim_id) AS nth FROM (
          SELECT DISTINCT question_id, claim_id, status, type, description FROM {wanted} w JOIN claims_t c ON c.subject_id = w.entity_id OR c.object_id = w.entity_id) a) b WHERE nth <= 10""",
    "ctx": "SELECT question_id, substr(string_agg(line, chr(10) ORDER BY block, nth), 1, 6000) AS context FROM clines GROUP BY question_id",
}


def _context_ctes(wanted: str) -> dict[str, str]:
    return {k: v.replace("{wanted}", wanted) for k, v in _CONTEXT.items()}


@register(
    "gather_context",
    with_views("entities_v", "rel_v", **SEED, **_TOP10, **_context_ctes("top10")) + "SELECT question_id, context FROM ctx",
)
def gather_context(spark, sf):
    g = graph(spark, sf, False)
    return an.gather_context(activated(spark, sf, g), g)


def activated(spark, sf, g):
    """The ten strongest entities per question."""
    from pyspark.sql import Window

    from ..operators.traverse import spread

    active = spread(g.relationships, cut(an.seed_entities(asked(spark, sf), g)))
    w = Window.partitionBy("question_id").orderBy(F.desc("activation"), "entity_id")
    return cut(active.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= an.TOP_POINTS))


def fixture_completer(batches):
    """Deterministic answers by kind of prompt; every fourth question gets prose."""
    import hashlib

    for b in batches:
        out = []
        for system, user in zip(b["system"], b["user"]):
            n = len(user)
            if "key points relevant" in system:
                first = user.split("### ", 1)[-1].split(" (level", 1)[0]
                out.append('[{"point": "%s", "score": %d.5}, {"point": "", "score": 9}, {"point": "size %d", "score": "x"}]' % (first, n % 9, n))
            elif "draft an answer" in system:
                out.append('ok {"draft": "draft %d", "follow_ups": ["nation_%d and economy", " ", "large ring parts"]}' % (n, n % 25))
            elif n % 4 == 0:
                out.append("plain words [[Doc %d]]" % (n % 100))
            else:
                out.append('{"answer": "answer %s", "citations": %s}' % (hashlib.sha256(user.encode()).hexdigest()[:12], '["A", " "]' if n % 2 else "[]"))
        yield b[["cache_key"]].assign(response=out)


def _cache(spark):
    return spark.createDataFrame([], "cache_key string, response string")


_ANSWER_SYSTEM = an._answer_system("spreading-activation").replace("'", "''")


@register(
    "activation_search",
    with_views("entities_v", "rel_v", **SEED, **_TOP10, **_context_ctes("top10"),
        prompt="SELECT q.question_id, concat('Graph context:', chr(10), context, chr(10), chr(10), 'Question:', chr(10), q.text) AS u FROM questions_v q JOIN ctx USING (question_id)")
    + """SELECT question_id, CASE WHEN length(u) % 4 = 0 THEN concat('plain words [[Doc ', length(u) % 100, ']]') ELSE concat('answer ', substr(sha256(u), 1, 12)) END AS text,
         'activation' AS mode, true AS used_model FROM prompt
         UNION ALL SELECT question_id, 'No graph entities matched this question yet.', 'activation', false FROM questions_v WHERE question_id NOT IN (SELECT question_id FROM prompt)""",
)
def activation_search(spark, sf):
    return an.activation_search(asked(spark, sf), graph(spark, sf, False), _cache(spark), fixture_completer).answers


@register("local_search")
def local_search(spark, sf):
    return an.local_search(asked(spark, sf), graph(spark, sf, False), _cache(spark), fixture_completer).answers


_REPORTS = {
    "comm": COMMUNITIES,
    "reps": """SELECT level, cluster, CASE WHEN cluster % 7 IN (3, 5) THEN 'Untitled community' ELSE concat('Group ', cluster) END AS title,
         CASE WHEN cluster % 7 = 3 THEN '' WHEN cluster % 7 = 5 THEN concat('about ', cluster) ELSE concat('members of ', cluster, ' in level ', level) END AS summary
         FROM (SELECT DISTINCT level, cluster FROM comm) x""",
    "batches": """SELECT batch, string_agg(concat('### ', title, ' (level ', level, ', cluster ', cluster, ')', chr(10), summary), concat(chr(10), chr(10)) ORDER BY cluster) AS block,
         min_by(title, cluster) AS first FROM (SELECT *, (row_number() OVER (ORDER BY cluster) - 1) // 5 AS batch FROM reps WHERE level = (SELECT max(level) FROM reps)) x GROUP BY batch""",
    "maps": """SELECT q.question_id, q.text, batch, first, concat('Community reports:', chr(10), block, chr(10), chr(10), 'Question:', chr(10), q.text) AS u
         FROM questions_v q CROSS JOIN batches""",
    "points": """SELECT question_id, batch, 0 AS pos, first AS point, length(u) % 9 + 0.5 AS score FROM maps
         UNION ALL SELECT question_id, batch, 2, concat('size ', length(u)), 0.0 FROM maps""",
    "best": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, batch, pos) AS rank FROM points) x WHERE rank <= 10""",
}


@register("report_batches", with_views(**{"questions_v": ASKED, **_REPORTS}) + "SELECT batch, block FROM batches")
def report_batches(spark, sf):
    return an.report_batches(reports(spark, sf))


@register("global_points", with_views(**{"questions_v": ASKED, **_REPORTS}) + "SELECT question_id, batch, pos, point, score, rank FROM best")
def global_points(spark, sf):
    g = an.Graph(*[None] * 7)._replace(reports=reports(spark, sf))
    return an.global_search(asked(spark, sf), g, _cache(spark), fixture_completer).details


@register(
    "global_search",
    with_views(**{"questions_v": ASKED, **_REPORTS,
        "red": """SELECT question_id, concat('Key points:', chr(10), string_agg(concat('- (', printf('%.1f', score), ') ', point), chr(10) ORDER BY rank), chr(10), chr(10),
                  'Question:', chr(10), any_value(q.text)) AS u FROM best JOIN questions_v q USING (question_id) GROUP BY question_id"""})
    + """SELECT question_id, CASE WHEN length(u) % 4 = 0 THEN concat('plain words [[Doc ', length(u) % 100, ']]') ELSE concat('answer ', substr(sha256(u), 1, 12)) END AS text,
         'global' AS mode, true AS used_model FROM red""",
)
def global_search(spark, sf):
    g = an.Graph(*[None] * 7)._replace(reports=reports(spark, sf))
    return an.global_search(asked(spark, sf), g, _cache(spark), fixture_completer).answers


@register(
    "top_reports",
    with_views(**{"questions_v": ASKED, **_REPORTS,
        "ws": "SELECT DISTINCT question_id, w FROM (SELECT question_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM questions_v) x WHERE w <> ''",
        "lex": """SELECT q.question_id, r.level, r.cluster, r.title, (SELECT count(*) FROM ws WHERE ws.question_id = q.question_id
                  AND contains(lower(concat(r.title, ' ', r.summary)), ws.w)) AS score FROM questions_v q CROSS JOIN reps r"""})
    + """SELECT question_id, level, cluster, title, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, level, cluster) AS rank FROM lex) x
         WHERE rank <= 5""",
)
def top_reports(spark, sf):
    g = an.Graph(*[None] * 7)._replace(reports=reports(spark, sf))
    return an.top_reports(asked(spark, sf), g).select("question_id", "level", "cluster", "title", "rank")


@register("drift_search")
def drift_search(spark, sf):
    return an.drift_search(asked(spark, sf), graph(spark, sf), _cache(spark), fixture_completer).answers


_MODES = "CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'auto' WHEN 2 THEN 'legacy' WHEN 3 THEN 'global' WHEN 4 THEN 'local' WHEN 5 THEN 'drift' ELSE 'auto' END"


@register(
    "resolve_mode",
    f"""SELECT doc_id, CASE WHEN mode IS NULL OR mode = 'legacy' THEN 'legacy' WHEN mode = 'auto' THEN CASE WHEN regexp_matches(lower(text),
        'overview|summary|summarize|overall|in general|across the vault') THEN 'global' ELSE 'local' END ELSE mode END AS resolved
        FROM (SELECT doc_id, concat(text, CASE WHEN doc_id % 2 = 0 THEN ' Overall?' ELSE '' END) AS text, {_MODES} AS mode FROM documents) x""",
)
def resolve_mode(spark, sf):
    d = inputs.table(spark, sf, "documents")
    q = d.select("doc_id", F.concat("text", F.when(F.col("doc_id") % 2 == 0, " Overall?").otherwise(F.lit(""))).alias("text"), F.expr(_MODES).alias("mode"))
    return an.resolve_mode(q, True).select("doc_id", "resolved")


_PAGE_ANSWERS = {
    "blocks": """SELECT h.question_id, string_agg(concat('### [[', title, ']] (`', page_path, '`)', chr(10), chr(10), substr(body, 1, 2000)), concat(chr(10), chr(10)) ORDER BY rank) AS b
                 FROM hits h JOIN pages_v p ON p.doc_id = h.doc_id GROUP BY h.question_id""",
    "ups": """SELECT q.question_id, concat('## Recent context', chr(10), chr(10), '(empty)', chr(10), chr(10), '## Retrieved pages', chr(10), chr(10),
              coalesce(b, '(no pages retrieved)'), chr(10), chr(10), '## Question', chr(10), chr(10), q.text, chr(10)) AS u FROM questions_v q LEFT JOIN blocks USING (question_id)""",
}


def _page_answers(spark, sf):
    _, p, s = _index(spark, sf)
    q = questions(spark, sf)
    v = inputs.view(spark, sf, "pages_v")
    hits = cut(ps.bm25(q, p, s, 8)).join(v.select("doc_id", "page_path"), "doc_id").select("question_id", F.col("page_path").alias("doc_id"), "rank")
    return an.page_answers(q, hits, pages(spark, sf), _cache(spark), fixture_completer)


@register(
    "page_answers",
    with_views("pages_v", "questions_v", **postings_ctes(), **bm25_ctes(8), **_PAGE_ANSWERS)
    + """SELECT question_id, CASE WHEN length(u) % 4 = 0 THEN concat('plain words [[Doc ', length(u) % 100, ']]') ELSE concat('answer ', substr(sha256(u), 1, 12)) END AS text,
         'legacy' AS mode, true AS used_model FROM ups""",
)
def page_answers(spark, sf):
    return _page_answers(spark, sf).answers


@register(
    "page_citations",
    with_views("pages_v", "questions_v", **postings_ctes(), **bm25_ctes(8), **_PAGE_ANSWERS)
    + """SELECT question_id, 0 AS pos, CASE WHEN length(u) % 4 = 0 THEN concat('Doc ', length(u) % 100) ELSE 'A' END AS title FROM ups
         WHERE length(u) % 4 = 0 OR length(u) % 2 = 1""",
)
def page_citations(spark, sf):
    return _page_answers(spark, sf).citations


@register("answer")
def answer(spark, sf):
    """All modes at once, by question number."""
    modes = F.element_at(F.array(*[F.lit(m) for m in ("auto", "local", "activation", "global", "drift", "legacy")]), F.col("question_id") % 6 + 1)
    q = asked(spark, sf).withColumn("mode", modes)
    p = pages(spark, sf)
    d = p.select(F.col("page_path").alias("doc_id"), "title", "body")
    postings = cut(ps.build_postings(d))
    stats = cut(ps.corpus_stats(d, postings))
    return an.answer(
        q, graph(spark, sf), lambda qs: ps.bm25(qs, postings, stats, 8), p, _cache(spark), fixture_completer
    ).answers
