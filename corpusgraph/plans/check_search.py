"""Check queries: full-text, vectors, hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import hybrid, links as lk, postings as ps, vectors as vx
from ..session import cut
from . import inputs
from .catalog import docs, pages, questions, register, with_views

TOKENS = "regexp_extract_all(strip_accents(lower({c})), '[\\p{{L}}\\p{{N}}]+')"
TOK_TITLE, TOK_BODY, TOK_TEXT = (TOKENS.format(c=c) for c in ("title", "body", "text"))


def postings_ctes(source: str = "pages_v", doc: str = "doc_id", title: str = "title", body: str = "body") -> dict[str, str]:
    t, b = TOKENS.format(c=title), TOKENS.format(c=body)
    return {
        "toks": f"SELECT {doc} AS doc_id, {t} AS t, {b} AS b FROM {source}",
        "postings": """
            SELECT doc_id, term, count(*) AS tf, sum(is_title) AS tf_title, any_value(dl) AS dl FROM (
              SELECT doc_id, unnest(t) AS term, 1 AS is_title, len(t)+len(b) AS dl FROM toks
              UNION ALL SELECT doc_id, unnest(b), 0, len(t)+len(b) FROM toks) u GROUP BY doc_id, term""",
        "stats": "SELECT count(*) AS n_docs, avg(len(t)+len(b)) AS avgdl FROM toks",
        "qterms": """
            SELECT question_id, term, count(*) AS qtf FROM (
              SELECT question_id, unnest(regexp_extract_all(lower(replace(r, '_', ' ')), '[a-z0-9]+')) AS term FROM (
                SELECT question_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS r FROM questions_v) x) y
            GROUP BY question_id, term""",
        "freq": "SELECT term, count(*) AS df FROM postings GROUP BY term",
        "scored": """
            SELECT question_id, p.doc_id, round(sum(qtf * greatest(ln((n_docs - df + 0.5)/(df + 0.5)), 1e-6)
                     * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
            FROM qterms q JOIN freq USING (term) JOIN postings p USING (term), stats GROUP BY question_id, p.doc_id""",
    }


def bm25_ctes(limit: int) -> dict[str, str]:
    return {
        "hits": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank
                 FROM scored) r WHERE rank <= {limit}"""
    }


def embed_ctes(name: str, source: str, id_col: str, text: str) -> dict[str, str]:
    """Sparse signed buckets ``(id, bucket, v)`` and norms of a text column."""
    return {
        f"{name}_b": f"""
            SELECT id, ('0x'||substr(h,1,8))::BIGINT % 64 AS bucket,
                   sum(CASE WHEN ('0x'||substr(h,9,2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS v
            FROM (SELECT id, sha256(tok) AS h FROM (
              SELECT {id_col} AS id, unnest(regexp_split_to_array(lower({text}), '\\s+')) AS tok FROM {source}) a WHERE tok <> '') b
            GROUP BY id, bucket""",
        f"{name}_n": f"SELECT id, sqrt(sum(v*v)) AS norm FROM {name}_b GROUP BY id",
    }


def cos_cte(pairs: str, q: str = "qe", d: str = "de") -> str:
    return f"""
        SELECT p.question_id, p.doc_id,
          round(coalesce(any_value(s.dot) / nullif(any_value(qn.norm) * any_value(dn.norm), 0), 0.0), 6) AS cosine
        FROM {pairs} p
        LEFT JOIN (SELECT p.question_id, p.doc_id, sum(a.v*b.v) AS dot FROM {pairs} p
                   JOIN {q}_b a ON a.id = p.question_id JOIN {d}_b b ON b.id = p.doc_id AND b.bucket = a.bucket
                   GROUP BY ALL) s ON s.question_id = p.question_id AND s.doc_id = p.doc_id
        LEFT JOIN {q}_n qn ON qn.id = p.question_id LEFT JOIN {d}_n dn ON dn.id = p.doc_id
        GROUP BY p.question_id, p.doc_id"""


@register(
    "postings_plain",
    with_views("pages_v", "questions_v", **postings_ctes()) + "SELECT doc_id, term, tf, tf_title, dl FROM postings",
)
def postings_plain(spark, sf):
    return ps.build_postings(docs(spark, sf))


@register("postings_porter")
def postings_porter(spark, sf):
    return ps.build_postings(docs(spark, sf), analyzer="porter")


@register(
    "query_terms",
    with_views("pages_v", "questions_v", **postings_ctes()) + "SELECT question_id, term, qtf FROM qterms",
)
def query_terms(spark, sf):
    return ps.query_terms(questions(spark, sf))


def _index(spark, sf):
    d = docs(spark, sf)
    p = cut(ps.build_postings(d))
    return d, p, cut(ps.corpus_stats(d, p))


@register(
    "bm25_top20",
    with_views("pages_v", "questions_v", **postings_ctes(), **bm25_ctes(20)) + "SELECT question_id, doc_id, score, rank FROM hits",
)
def bm25_top20(spark, sf):
    _, p, s = _index(spark, sf)
    return ps.bm25(questions(spark, sf), p, s, 20)


@register(
    "snippet_fallback",
    with_views("pages_v")
    + """SELECT page_path, concat(substr(b, 1, 160), CASE WHEN length(b) > 160 THEN '...' ELSE '' END) AS snippet
         FROM (SELECT page_path, regexp_replace(body, '^\\s+|\\s+$', '', 'g') AS b FROM pages_v) x""",
)
def snippet_fallback(spark, sf):
    return pages(spark, sf).select("page_path", ps.fallback_snippet(F.col("body")).alias("snippet"))


@register("snippets")
def snippets(spark, sf):
    d, p, s = _index(spark, sf)
    q = questions(spark, sf)
    hits = cut(ps.bm25(q, p, s, 8))
    return ps.snippets(hits, d, ps.query_terms(q))


@register(
    "hash_buckets_documents",
    with_views(**embed_ctes("de", "documents", "doc_id", "text")) + "SELECT id AS doc_id, bucket, v AS value FROM de_b",
)
def hash_buckets_documents(spark, sf):
    return vx.hash_buckets(inputs.table(spark, sf, "documents"), "doc_id", "text")


@register(
    "hash_embed_questions",
    with_views("questions_v", **embed_ctes("qe", "questions_v", "question_id", "text"))
    + """SELECT q.question_id, g.pos::BIGINT AS pos, round(coalesce(v / norm, 0.0), 6) + 0.0 AS value
         FROM questions_v q CROSS JOIN range(64) g(pos) LEFT JOIN qe_b b ON b.id = q.question_id AND b.bucket = g.pos
         LEFT JOIN qe_n n ON n.id = q.question_id""",
)
def hash_embed_questions(spark, sf):
    v = vx.hash_embed(questions(spark, sf), "question_id", "text")
    return v.select("question_id", F.posexplode("vector").alias("pos", "value")).select(
        "question_id", F.col("pos").cast("long").alias("pos"), (F.round("value", 6) + 0.0).alias("value")
    )


def _page_vectors(spark, sf):
    d = docs(spark, sf).select("doc_id", F.concat_ws("\n", "title", "body").alias("text"))
    return cut(vx.hash_embed(d, "doc_id", "text"))


_DE = embed_ctes("de", "pages_v", "doc_id", "concat(title, chr(10), body)")
_QE = embed_ctes("qe", "questions_v", "question_id", "text")


@register(
    "cosine_candidates",
    with_views("pages_v", "questions_v", **postings_ctes(), **bm25_ctes(32), **_DE, **_QE)
    + "SELECT * FROM (" + cos_cte("hits") + ") c",
)
def cosine_candidates(spark, sf):
    _, p, s = _index(spark, sf)
    q = questions(spark, sf)
    hits = cut(ps.bm25(q, p, s, 32))
    return vx.cosine(vx.hash_embed(q, "question_id", "text"), _page_vectors(spark, sf), hits)


@register(
    "nearest_pages",
    with_views("pages_v", "questions_v", **_DE, **_QE, pairs="SELECT question_id, doc_id FROM questions_v CROSS JOIN pages_v", c=cos_cte("pairs"))
    + """SELECT question_id, doc_id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY cosine DESC, doc_id) AS rank
         FROM c) r WHERE rank <= 10""",
)
def nearest_pages(spark, sf):
    q = vx.hash_embed(questions(spark, sf), "question_id", "text")
    return vx.nearest(q, _page_vectors(spark, sf), 10)


@register(
    "nearest_embeddings",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
       c AS (SELECT a.vec_id AS question_id, b.vec_id AS doc_id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM e a CROSS JOIN e b)
       SELECT question_id, doc_id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY cosine DESC, doc_id) AS rank
       FROM c) r WHERE rank <= 5""",
)
def nearest_embeddings(spark, sf):
    e = inputs.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return vx.nearest(
        e.withColumnRenamed("vec_id", "question_id"), e.withColumnRenamed("vec_id", "doc_id"), 5
    )


_HYBRID = {
    "cand": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS r0
               FROM scored) r WHERE r0 <= 32""",
    "ccos": cos_cte("cand"),
    "mixed": """SELECT question_id, doc_id, round(0.45 * score / CASE WHEN top = 0 THEN 1.0 ELSE top END
                + 0.55 * greatest(coalesce(cosine, 0.0), 0.0), 6) AS score
                FROM (SELECT *, max(score) OVER (PARTITION BY question_id) AS top FROM cand) c LEFT JOIN ccos USING (question_id, doc_id)""",
    "hyb": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank
              FROM mixed) r WHERE rank <= 8""",
}


def _hybrid(spark, sf, k=8):
    _, p, s = _index(spark, sf)
    q = questions(spark, sf)
    qv = cut(vx.hash_embed(q, "question_id", "text"))
    return hybrid.hybrid_search(q, p, s, qv, _page_vectors(spark, sf), k)


@register(
    "hybrid_search",
    with_views("pages_v", "questions_v", **postings_ctes(), **_DE, **_QE, **_HYBRID)
    + "SELECT question_id, doc_id, score, rank, 'hybrid' AS tier FROM hyb",
)
def hybrid_search(spark, sf):
    return _hybrid(spark, sf)


_LINKS = {
    "raw_links": """SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS pos FROM (
                      SELECT doc_id, regexp_extract_all(body, '\\[\\[([^\\]|#]+)(?:[|#][^\\]]*)?\\]\\]', 1) AS l FROM pages_v) x""",
    "blinks": "SELECT doc_id, pos, lower(trim(t)) AS key FROM raw_links",
    "titles": "SELECT lower(title) AS key, doc_id FROM pages_v",
}


@register(
    "expand_links",
    with_views("pages_v", "questions_v", **postings_ctes(), **bm25_ctes(3), **_LINKS,
        walked="""SELECT * FROM (SELECT h.question_id, h.rank AS sr, h.score AS seed, b.pos, b.key,
                     row_number() OVER (PARTITION BY h.question_id, b.key ORDER BY h.rank, b.pos) AS nth
                  FROM hits h JOIN blinks b USING (doc_id)) w WHERE nth = 1""",
        added="""SELECT w.question_id, t.doc_id, w.seed, row_number() OVER (PARTITION BY w.question_id ORDER BY sr, pos) AS n
                 FROM walked w JOIN titles t USING (key)
                 WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.question_id = w.question_id AND h.doc_id = t.doc_id)""",
        have="SELECT question_id, max(rank) AS have FROM hits GROUP BY question_id")
    + """SELECT question_id, doc_id, score, rank::INT AS rank, 'bm25' AS tier FROM hits
         UNION ALL SELECT a.question_id, a.doc_id, round(seed*0.5, 7), (have + n)::INT, 'expanded'
         FROM added a JOIN have USING (question_id) WHERE have + n <= 8""",
)
def expand_links(spark, sf):
    _, p, s = _index(spark, sf)
    hits = cut(ps.bm25(questions(spark, sf), p, s, 3).withColumn("tier", F.lit("bm25")))
    v = inputs.view(spark, sf, "pages_v")
    pg = v.select("doc_id", F.col("page_path"), "title", "body")
    found = lk.extract_links(pg).join(pg.select("page_path", "doc_id"), "page_path").select("doc_id", "pos", "key")
    titles = lk.title_index(pg).join(pg.select("page_path", "doc_id"), "page_path").select("key", "doc_id")
    return hybrid.expand_links(hits, found, titles, 8)
