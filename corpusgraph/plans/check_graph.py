"""Check queries: edges, traversal, communities, centrality, views, terrain, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import (
    centrality as ce, communities as cm, components as co, edges as ed, links as lk, merge as mg, reports as rp,
    terrain as tr, traverse as tv, views as vw,
)
from ..session import cut
from . import inputs
from .catalog import pages, register, with_views
from .check_pages import L

# Regions as communities of level 0 and nations of level 1; parts are dealt over both.
COMMUNITIES = """
SELECT 0 AS level, CAST(r_regionkey AS BIGINT) AS cluster, CAST(30000000+r_regionkey AS BIGINT) AS entity_id FROM region
UNION ALL SELECT 0, n_regionkey, 20000000+n_nationkey FROM nation
UNION ALL SELECT 1, 100+n_nationkey, 20000000+n_nationkey FROM nation
UNION ALL SELECT 0, n_regionkey, 10000000+s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 1, 100+s_nationkey, 10000000+s_suppkey FROM supplier
UNION ALL SELECT 0, p_partkey%5, p_partkey FROM part
UNION ALL SELECT 1, 100+p_partkey%25, p_partkey FROM part"""

SEEDS = """
SELECT item_id AS question_id, 10000000 + item_id % (SELECT count(*) FROM supplier) AS entity_id, CAST(1.0 AS DOUBLE) AS value FROM benchmark
UNION ALL SELECT item_id, (item_id*37) % (SELECT count(*) FROM part), CAST(0.5 AS DOUBLE) FROM benchmark
UNION ALL SELECT item_id, 99000000 + item_id, CAST(0.9 AS DOUBLE) FROM benchmark"""

MERGED = """SELECT source_id, target_id, type, max(weight) AS weight,
  coalesce(max_by(description, l_orderkey * 1000 + l_linenumber) FILTER (WHERE description <> ''), '') AS description
  FROM rel_v GROUP BY source_id, target_id, type"""


def _sql(spark, sf, text):
    import re

    for t in inputs.TABLES:
        if re.search(rf"\b{t}\b", text):
            inputs.table(spark, sf, t).createOrReplaceTempView(t)
    return spark.sql(text)


def communities_v(spark, sf):
    return _sql(spark, sf, COMMUNITIES)


def seeds_v(spark, sf):
    return _sql(spark, sf, SEEDS)


def relationships(spark, sf):
    """Order lines merged to one relationship per pair."""
    return cut(mg.merge_relationships(inputs.view(spark, sf, "rel_v"), order=("l_orderkey", "l_linenumber")))


def entities(spark, sf):
    return inputs.view(spark, sf, "entities_v")


_UND = {"und": """SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, sum(weight) AS weight FROM rel_v
                 WHERE source_id <> target_id GROUP BY ALL"""}


@register("undirected_edges", with_views("rel_v", **_UND) + "SELECT a, b, weight FROM und")
def undirected_edges(spark, sf):
    return ed.undirected_edges(inputs.view(spark, sf, "rel_v"))


_ADJ = {
    "seeds": SEEDS,
    "adj": """SELECT src, dst, max(weight) AS w FROM (SELECT source_id AS src, target_id AS dst, weight FROM rel_v
              UNION ALL SELECT target_id, source_id, weight FROM rel_v) x GROUP BY src, dst""",
}
_HOPS = {
    "h0": "SELECT DISTINCT question_id, entity_id FROM seeds WHERE entity_id IN (SELECT entity_id FROM entities_v)",
    "h1": "SELECT DISTINCT question_id, dst AS entity_id FROM h0 JOIN adj ON src = entity_id",
    "h2": "SELECT DISTINCT question_id, dst AS entity_id FROM h1 JOIN adj ON src = entity_id",
}


@register(
    "k_hop",
    with_views("rel_v", "entities_v", **_ADJ, **_HOPS)
    + """SELECT question_id, entity_id, min(hop) AS hop FROM (SELECT *, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) x
         GROUP BY question_id, entity_id""",
)
def k_hop(spark, sf):
    return tv.k_hop(inputs.view(spark, sf, "rel_v"), entities(spark, sf), seeds_v(spark, sf), 2)


def _spread_ctes(seeds: str) -> dict[str, str]:
    out = {"mw": "SELECT max(weight) AS m FROM rel_v", "s0": f"SELECT question_id, entity_id, value AS a FROM {seeds}"}
    for i in range(1, 5):
        out[f"s{i}"] = f"""SELECT question_id, entity_id, max(a) AS a FROM (SELECT question_id, dst AS entity_id, a * 0.6::DOUBLE * (w / m) AS a FROM s{i-1}
                           JOIN adj ON src = entity_id, mw) x WHERE a >= 0.05 GROUP BY ALL"""
    union = " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(5))
    out["spreaded"] = f"SELECT question_id, entity_id, round(max(a), 9) AS activation FROM ({union}) u GROUP BY ALL HAVING max(a) >= 0.05"
    return out


@register("spread", with_views("rel_v", **_ADJ, **_spread_ctes("seeds")) + "SELECT question_id, entity_id, activation FROM spreaded")
def spread(spark, sf):
    return tv.spread(inputs.view(spark, sf, "rel_v"), seeds_v(spark, sf))


def _page_graph(spark, sf):
    p = pages(spark, sf)
    edges = lk.page_edges(p, lk.extract_links(p))
    nodes = p.select(F.col("page_path").alias("id"), "title", F.col("page_type").alias("type"))
    return nodes, cut(edges)


_PAGE_EDGES = {**L, "pedges": "SELECT DISTINCT page_path AS source, target_path AS target FROM links JOIN tix USING (key) WHERE page_path <> target_path"}


@register(
    "neighbors",
    with_views("pages_v", **_PAGE_EDGES)
    + """SELECT DISTINCT id FROM (SELECT target AS id FROM pedges WHERE source = 'wiki/concepts/doc-10.md' UNION ALL
         SELECT source FROM pedges WHERE target = 'wiki/concepts/doc-10.md') x""",
)
def neighbors(spark, sf):
    return ed.neighbors(_page_graph(spark, sf)[1], "wiki/concepts/doc-10.md")


_WANT = {"want": "SELECT p_partkey AS entity_id FROM part WHERE p_type = 'ECONOMY' UNION ALL SELECT 10000000+s_suppkey FROM supplier WHERE s_acctbal > 0"}


def _wanted(spark, sf):
    return _sql(spark, sf, _WANT["want"])


@register(
    "edges_among",
    with_views("rel_v", **_WANT)
    + "SELECT source_id, target_id, l_orderkey, l_linenumber FROM rel_v WHERE source_id IN (SELECT * FROM want) AND target_id IN (SELECT * FROM want)",
)
def edges_among(spark, sf):
    return ed.edges_among(inputs.view(spark, sf, "rel_v"), _wanted(spark, sf)).select("source_id", "target_id", "l_orderkey", "l_linenumber")


@register(
    "edges_touching",
    with_views("rel_v", **_WANT)
    + "SELECT source_id, target_id, l_orderkey, l_linenumber FROM rel_v WHERE source_id IN (SELECT * FROM want) OR target_id IN (SELECT * FROM want)",
)
def edges_touching(spark, sf):
    return ed.edges_touching(inputs.view(spark, sf, "rel_v"), _wanted(spark, sf)).select("source_id", "target_id", "l_orderkey", "l_linenumber")


_COMP = {
    **_PAGE_EDGES,
    "sym": "SELECT source AS u, target AS v FROM pedges UNION SELECT target, source FROM pedges",
    "walk": "SELECT page_path AS root, page_path AS id FROM pages_v UNION SELECT w.root, s.v FROM walk w JOIN sym s ON s.u = w.id WHERE s.v > w.root",
    "comp": "SELECT id, min(root) AS root FROM walk GROUP BY id",
}
_FNV = """list_reduce(list_transform(string_split(root, ''), lambda c: unicode(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT) % 8"""


@register("components", with_views("pages_v", **_COMP) + "SELECT id, root FROM comp")
def components(spark, sf):
    return co.components(*_page_graph(spark, sf))


@register(
    "fallback_communities",
    with_views("pages_v", **_COMP, own="SELECT page_path AS id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 13 END AS community FROM pages_v")
    + f"""SELECT id, coalesce(community, (SELECT coalesce(max(community), -1) + 1 FROM own) + {_FNV}) AS community, community IS NULL AS approximate
          FROM own JOIN comp USING (id)""",
)
def fallback_communities(spark, sf):
    _, edges = _page_graph(spark, sf)
    v = inputs.view(spark, sf, "pages_v")
    nodes = v.select(F.col("page_path").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 13).alias("community"))
    return co.fallback_communities(nodes, edges)


def _page_entities(spark, sf):
    """The page link graph with numbers as ids."""
    v = inputs.view(spark, sf, "pages_v").select("doc_id", "page_path")
    _, e = _page_graph(spark, sf)
    a = e.join(v.select(F.col("page_path").alias("source"), F.col("doc_id").alias("source_id")), "source").join(
        v.select(F.col("page_path").alias("target"), F.col("doc_id").alias("target_id")), "target"
    )
    rel = a.select("source_id", "target_id", F.lit(1.0).alias("weight"))
    return v.select(F.col("doc_id").alias("entity_id")), ed.undirected_edges(rel)


@register("communities_pages")
def communities_pages(spark, sf):
    nodes, edges = _page_entities(spark, sf)
    return cm.communities(edges, nodes)


@register("communities_orders")
def communities_orders(spark, sf):
    rel = inputs.view(spark, sf, "rel_v")
    return cm.communities(ed.undirected_edges(rel), entities(spark, sf))


_POWER = {
    **_UND,
    "psym": """SELECT a AS src, b AS dst, weight AS w FROM und UNION ALL SELECT b, a, weight FROM und""",
    "x0": "SELECT src AS node, 1.0::DOUBLE AS x FROM psym GROUP BY src",
    **{
        f"x{i}": f"""SELECT node, sum(x) AS x FROM (SELECT node, x FROM x{i-1} UNION ALL SELECT dst, x * w FROM x{i-1} JOIN psym ON src = node) u GROUP BY node"""
        for i in range(1, 21)
    },
}


@register(
    "eigenvector_orders",
    with_views("rel_v", "entities_v", **_POWER)
    + "SELECT entity_id, round(coalesce(x / (SELECT max(x) FROM x20), 0.0), 6) AS score FROM entities_v LEFT JOIN x20 ON node = entity_id",
)
def eigenvector_orders(spark, sf):
    """Twenty iterations: the graph is nearly bipartite, so the cap decides, not convergence."""
    rel = inputs.view(spark, sf, "rel_v")
    c = ce.eigenvector(ed.undirected_edges(rel), entities(spark, sf).select("entity_id"), max_iterations=20)
    return c.scores.withColumn("score", F.round("score", 6))


@register("eigenvector_pages")
def eigenvector_pages(spark, sf):
    nodes, edges = _page_entities(spark, sf)
    c = ce.eigenvector(edges, nodes)
    return c.scores.withColumn("converged", F.lit(c.converged))


_DEG = {"deg": """SELECT entity_id, count(*) AS degree FROM (SELECT source_id AS entity_id FROM rel_v UNION ALL SELECT target_id FROM rel_v
                 WHERE target_id <> source_id) x GROUP BY entity_id"""}


def _scores(spark, sf):
    """Account balance and price as stand-in scores with an exact counterpart."""
    return _sql(spark, sf, "SELECT p_partkey AS entity_id, p_retailprice / 4000.0 AS score FROM part UNION ALL SELECT 10000000+s_suppkey, s_acctbal / 20000.0 FROM supplier")


_SCORES = {"scores": "SELECT p_partkey AS entity_id, p_retailprice / 4000.0 AS score FROM part UNION ALL SELECT 10000000+s_suppkey, s_acctbal / 20000.0 FROM supplier"}
_ENRICH = {
    "comm": COMMUNITIES, **_DEG, **_SCORES,
    "fine": "SELECT entity_id, max(level) AS level, max_by(cluster, level) AS community FROM comm GROUP BY entity_id",
    "enr": """SELECT f.entity_id, f.community, f.level, round(coalesce(degree, 0) / (SELECT max(degree) FROM deg JOIN fine USING (entity_id)), 6) AS degree,
              round(coalesce(score, 0.0), 6) AS eigenvector, c0.cluster AS parent0
              FROM fine f LEFT JOIN deg USING (entity_id) LEFT JOIN scores USING (entity_id)
              LEFT JOIN comm c0 ON c0.entity_id = f.entity_id AND c0.level = 0 AND f.level <> 0""",
}


def _enriched(spark, sf):
    return vw.enrich_nodes(communities_v(spark, sf), mg.degree(inputs.view(spark, sf, "rel_v")), _scores(spark, sf))


@register("enrich_nodes", with_views("rel_v", **_ENRICH) + "SELECT * FROM enr")
def enrich_nodes(spark, sf):
    e = _enriched(spark, sf)
    return e.select(
        "entity_id", "community", "level", F.col("centrality.degree").alias("degree"), F.col("centrality.eigenvector").alias("eigenvector"),
        F.col("parent_community")[0].alias("parent0"),
    )


_VIZ = {**_PAGE_EDGES, "cnt": "SELECT id, count(*) AS n FROM (SELECT source AS id FROM pedges UNION ALL SELECT target FROM pedges) x GROUP BY id",
        "viz": """SELECT p.page_path AS id, p.page_type AS type, p.doc_id % 13 AS community, coalesce(n, 0) AS degree,
                  0.6 + sqrt(coalesce(n, 0) / (SELECT greatest(coalesce(max(n), 1), 1) FROM cnt)) * 2.6 AS size FROM pages_v p LEFT JOIN cnt ON cnt.id = p.page_path"""}


def _viz(spark, sf):
    _, edges = _page_graph(spark, sf)
    v = inputs.view(spark, sf, "pages_v").select(F.col("page_path").alias("id"), F.col("page_type").alias("type"), (F.col("doc_id") % 13).alias("community"))
    return vw.viz_nodes(v, edges), edges


@register("viz_nodes", with_views("pages_v", **_VIZ) + "SELECT id, degree, round(size, 6) AS size FROM viz")
def viz_nodes(spark, sf):
    return _viz(spark, sf)[0].select("id", "degree", F.round("size", 6).alias("size"))


_VISIBLE = {
    **_VIZ,
    "top": "SELECT id FROM viz ORDER BY degree DESC, id LIMIT 150",
    "exp": "SELECT page_path AS id FROM pages_v WHERE tag = 'stub'",
    "base": """SELECT id FROM top UNION SELECT id FROM exp UNION SELECT target FROM pedges WHERE source IN (SELECT id FROM exp)
               UNION SELECT source FROM pedges WHERE target IN (SELECT id FROM exp)""",
    "shown": "SELECT * FROM viz WHERE id IN (SELECT id FROM base) AND type IN ('concept', 'entity') AND community IN (0, 1, 2, 3, 5, 8)",
}


def _visible(spark, sf):
    nodes, edges = _viz(spark, sf)
    exp = inputs.view(spark, sf, "pages_v").where("tag = 'stub'").select(F.col("page_path").alias("id"))
    return vw.visible_graph(nodes, edges, 150, exp, ("concept", "entity"), (0, 1, 2, 3, 5, 8))


@register("visible_nodes", with_views("pages_v", **_VISIBLE) + "SELECT id, type, community FROM shown")
def visible_nodes(spark, sf):
    return _visible(spark, sf)[0].select("id", "type", "community")


@register(
    "visible_edges",
    with_views("pages_v", **_VISIBLE)
    + "SELECT source, target FROM pedges WHERE source IN (SELECT id FROM shown) AND target IN (SELECT id FROM shown)",
)
def visible_edges(spark, sf):
    return _visible(spark, sf)[1]


@register("by_community", with_views("rel_v", **_ENRICH) + "SELECT community, count(*) AS members FROM enr GROUP BY community")
def by_community(spark, sf):
    return vw.by_community(_enriched(spark, sf).withColumnRenamed("entity_id", "id"))[0]


@register(
    "by_level",
    with_views("rel_v", **_ENRICH) + "SELECT level, community, count(*) AS members, min_by(parent0, entity_id) AS parent0 FROM enr GROUP BY level, community",
)
def by_level(spark, sf):
    g = vw.by_level(_enriched(spark, sf).withColumnRenamed("entity_id", "id"))[0]
    return g.select("level", "community", "members", F.col("parent_community")[0].alias("parent0"))


@register(
    "by_tier",
    with_views("entities_v", **_SCORES,
        t="""SELECT entity_id, coalesce(score, 0.1) AS v, least(4, floor(least(greatest(coalesce(score, 0.1), 0.0), 1.0) * 5)) AS tier
             FROM entities_v LEFT JOIN scores USING (entity_id)""")
    + """SELECT tier, ['Basin','Lowland','Midland','Highland','Peak'][tier::INT + 1] AS label, count(*) AS members, round(avg(v), 6) AS elevation FROM t GROUP BY tier""",
)
def by_tier(spark, sf):
    nodes = entities(spark, sf).join(_scores(spark, sf), "entity_id", "left").select(F.col("entity_id").alias("id"), F.col("score").alias("centrality"))
    return vw.by_tier(nodes)[0].withColumn("elevation", F.round("elevation", 6))


_POINTS = "SELECT o_orderkey AS id, CAST(o_totalprice / 200.0 AS DOUBLE) AS x, o_custkey * CAST(0.3 AS DOUBLE) AS z, CAST((o_orderkey % 7) / 2.0 AS DOUBLE) AS weight FROM orders"
_GRID = {
    "pts": _POINTS,
    "box": """SELECT (x0+x1)/2 - span/2 AS mx, (z0+z1)/2 - span/2 AS mz, span/48 AS cell FROM (SELECT *, greatest(40.0, x1-x0+40.0, z1-z0+40.0) AS span FROM (
              SELECT min(x) AS x0, max(x) AS x1, min(z) AS z0, max(z) AS z1 FROM pts) a) b""",
    "cells": """SELECT greatest(least(floor((z-mz)/cell), 47), 0)::INT AS r, greatest(least(floor((x-mx)/cell), 47), 0)::INT AS c, sum(weight) AS w
                FROM pts, box WHERE weight > 0 GROUP BY ALL""",
    "blur": """SELECT a.r AS r, b.c AS c, coalesce(sum(w), 0.0) / any_value((least(a.r+1, 47) - greatest(a.r-1, 0) + 1) * (least(b.c+1, 47) - greatest(b.c-1, 0) + 1)) AS h
               FROM range(48) a(r) CROSS JOIN range(48) b(c) LEFT JOIN cells k ON k.r BETWEEN a.r-1 AND a.r+1 AND k.c BETWEEN b.c-1 AND b.c+1 GROUP BY a.r, b.c""",
    "grid": "SELECT r::INT AS r, c::INT AS c, h / (SELECT max(h) FROM blur) AS height FROM blur",
}


@register("elevation_grid", with_views(**_GRID) + 'SELECT r AS "row", c AS col, round(height, 6) AS height FROM grid')
def elevation_grid(spark, sf):
    return tr.elevation_grid(_sql(spark, sf, _POINTS)).withColumn("height", F.round("height", 6))


@register(
    "sample_grid",
    with_views(**_GRID,
        spot="SELECT id, least(greatest((x-mx)/cell - 0.5, 0.0), 47.0) AS fx, least(greatest((z-mz)/cell - 0.5, 0.0), 47.0) AS fz FROM pts, box",
        k="SELECT id, floor(fx)::INT AS c0, floor(fz)::INT AS r0, least(floor(fx)+1, 47)::INT AS c1, least(floor(fz)+1, 47)::INT AS r1, fx - floor(fx) AS tx, fz - floor(fz) AS tz FROM spot")
    + """SELECT id, round((a.height + (b.height - a.height)*tx) + ((c.height + (d.height - c.height)*tx) - (a.height + (b.height - a.height)*tx))*tz, 5) AS height FROM k
         JOIN grid a ON a.r = r0 AND a.c = c0 JOIN grid b ON b.r = r0 AND b.c = c1 JOIN grid c ON c.r = r1 AND c.c = c0 JOIN grid d ON d.r = r1 AND d.c = c1""",
)
def sample_grid(spark, sf):
    pts = _sql(spark, sf, _POINTS)
    grid = cut(tr.elevation_grid(pts))
    return tr.sample_grid(pts, grid, tr.grid_frame(pts)).withColumn("height", F.round("height", 5))


@register("graph_view_wikilinks", with_views("pages_v", **_PAGE_EDGES) + "SELECT source, target FROM pedges")
def graph_view_wikilinks(spark, sf):
    p = pages(spark, sf)
    return vw.graph_view("wikilinks", p, lk.page_edges(p, lk.extract_links(p)))[1]


@register(
    "graph_view_entities",
    with_views("rel_v", "entities_v", **_DEG)
    + "SELECT concat('entity:', entity_id) AS id, title AS label, type, 'entity' AS kind, coalesce(degree, 0) AS degree FROM entities_v LEFT JOIN deg USING (entity_id)",
)
def graph_view_entities(spark, sf):
    rel = inputs.view(spark, sf, "rel_v")
    return vw.graph_view("entities", entities=mg.with_degree(entities(spark, sf), rel), relationships=rel)[0]


@register(
    "graph_edges_entities",
    with_views("rel_v", **{"m": MERGED}) + "SELECT concat('entity:', source_id) AS source, concat('entity:', target_id) AS target, type, weight FROM m",
)
def graph_edges_entities(spark, sf):
    rel = relationships(spark, sf)
    return vw.graph_view("entities", entities=entities(spark, sf).withColumn("degree", F.lit(0)), relationships=rel)[1]


# Pages named after parts and suppliers; the page hash names the document the entity came from
# for two thirds of them.  Part names repeat, so many titles are ambiguous.
_ID = {
    "pg": """SELECT concat('wiki/p-', p_partkey, '.md') AS id, p_name AS label, 'concept' AS type, 'page' AS kind, concat('h', p_partkey) AS source_hash FROM part
             UNION ALL SELECT concat('wiki/s-', s_suppkey, '.md'), lower(s_name), 'entity', 'page', concat('h', 10000000 + s_suppkey) FROM supplier""",
    "en": "SELECT concat('entity:', entity_id) AS id, title AS label, type, 'entity' AS kind, entity_id AS community FROM entities_v",
    "st": "SELECT concat('entity:', entity_id) AS id, concat('h', entity_id) AS stem FROM entities_v WHERE entity_id % 3 <> 0",
    "pe": "SELECT concat('wiki/s-', l_suppkey, '.md') AS source, concat('wiki/p-', l_partkey, '.md') AS target FROM lineitem GROUP BY ALL",
    "ee": "SELECT concat('entity:', source_id) AS source, concat('entity:', target_id) AS target, type, max(weight) AS weight FROM rel_v GROUP BY ALL",
    "pk": "SELECT upper(trim(regexp_replace(label, '\\s+', ' ', 'g'))) AS key, min(id) AS page_id FROM pg GROUP BY key HAVING count(*) = 1",
    "ek": "SELECT upper(trim(regexp_replace(label, '\\s+', ' ', 'g'))) AS key, min(id) AS ent_id FROM en GROUP BY key HAVING count(*) = 1",
    "pairs": """SELECT page_id, ent_id FROM pk JOIN ek USING (key) JOIN pg ON pg.id = page_id WHERE (ent_id, source_hash) IN (SELECT id, stem FROM st)""",
    "moved": """SELECT coalesce(a.page_id, e.source) AS source, coalesce(b.page_id, e.target) AS target, type, weight FROM ee e
                LEFT JOIN pairs a ON a.ent_id = e.source LEFT JOIN pairs b ON b.ent_id = e.target""",
}


def _identity(spark, sf):
    import re

    inputs.view(spark, sf, "entities_v").createOrReplaceTempView("entities_v")
    inputs.view(spark, sf, "rel_v").createOrReplaceTempView("rel_v")
    pg = _sql(spark, sf, _ID["pg"])
    ee = mg.merge_relationships(inputs.view(spark, sf, "rel_v"), order=("l_orderkey", "l_linenumber"))
    named = vw.entity_edges(ee).drop("source_id", "target_id")
    pe = _sql(spark, sf, _ID["pe"])
    return vw.merge_identity(
        pg.drop("source_hash"), pe, spark.sql(_ID["en"]), named, pg.select("id", "source_hash"), spark.sql(_ID["st"])
    )


@register(
    "merge_identity_nodes",
    with_views("rel_v", "entities_v", **_ID)
    + """SELECT pg.id, label, type, kind, ent_id AS entity_twin, CASE WHEN ent_id IS NOT NULL THEN substr(ent_id, 8)::BIGINT END AS community
         FROM pg LEFT JOIN pairs ON page_id = pg.id
         UNION ALL SELECT id, label, type, kind, NULL, community FROM en WHERE id NOT IN (SELECT ent_id FROM pairs)""",
)
def merge_identity_nodes(spark, sf):
    return _identity(spark, sf)[0].select("id", "label", "type", "kind", "entity_twin", "community")


@register(
    "merge_identity_edges",
    with_views("rel_v", "entities_v", **_ID)
    + """SELECT source, target, type, weight FROM moved WHERE source <> target
         UNION ALL SELECT source, target, NULL, NULL FROM pe WHERE (source, target) NOT IN (SELECT source, target FROM moved WHERE source <> target)""",
)
def merge_identity_edges(spark, sf):
    return _identity(spark, sf)[1].select("source", "target", "type", "weight")


# Lines of one report prompt: a community has one, whatever its size.
REPORT_LINES = None

REPORT = {
    "comm": COMMUNITIES, "m": MERGED,
    "el": """SELECT level, cluster, string_agg(concat('- ', title, ' (', type, '): ', description), chr(10) ORDER BY entity_id) AS e
             FROM comm JOIN entities_v USING (entity_id) GROUP BY level, cluster""",
    "rl": """SELECT a.level, a.cluster, string_agg(concat('- ', source_id, ' -> ', target_id, ' (', type, '): ', description, ' [weight ', weight::BIGINT, '.0]'), chr(10)
             ORDER BY source_id, target_id, type) AS r FROM m JOIN comm a ON a.entity_id = source_id
             JOIN comm b ON b.entity_id = target_id AND b.level = a.level AND b.cluster = a.cluster GROUP BY a.level, a.cluster""",
    "rprompts": """SELECT level, cluster, concat('Community level ', level, ', cluster ', cluster, '.', chr(10), chr(10), 'Member entities:', chr(10), e, chr(10), chr(10),
             'Relationships:', chr(10), coalesce(r, '(no relationships within this community)'), chr(10), chr(10),
             'Write the community report now, as the single JSON object described above.', chr(10)) AS usr FROM el LEFT JOIN rl USING (level, cluster)""",
}


def report_ctes(part_lines: int) -> dict[str, str]:
    """Report prompts in parts as SQL: a community's lines in as many as ``part_lines`` asks for, dealt by the MD5 of their keys."""
    return {
        "comm": COMMUNITIES, "m": MERGED,
        "lines": """SELECT level, cluster, 0 AS block, CAST(entity_id AS BIGINT) AS k1, CAST(0 AS BIGINT) AS k2, '' AS k3, concat('- ', title, ' (', type, '): ', description) AS line
             FROM comm JOIN entities_v USING (entity_id)
             UNION ALL SELECT a.level, a.cluster, 1, source_id, target_id, type, concat('- ', source_id, ' -> ', target_id, ' (', type, '): ', description, ' [weight ', weight::BIGINT, '.0]')
             FROM m JOIN comm a ON a.entity_id = source_id JOIN comm b ON b.entity_id = target_id AND b.level = a.level AND b.cluster = a.cluster""",
        "sized": f"SELECT level, cluster, ceil(count(*) / {part_lines})::BIGINT AS parts FROM lines GROUP BY level, cluster",
        "dealt": """SELECT *, ('0x' || substr(md5(concat_ws('|', block, k1, k2, k3)), 1, 8))::BIGINT % parts AS part FROM lines JOIN sized USING (level, cluster)""",
        "rprompts": """SELECT level, cluster, part, concat('Community level ', level, ', cluster ', cluster, '.', chr(10), chr(10), 'Member entities:', chr(10),
             coalesce(string_agg(line, chr(10) ORDER BY k1) FILTER (WHERE block = 0), '(no member entities)'), chr(10), chr(10), 'Relationships:', chr(10),
             coalesce(string_agg(line, chr(10) ORDER BY k1, k2, k3) FILTER (WHERE block = 1), '(no relationships within this community)'), chr(10), chr(10),
             'Write the community report now, as the single JSON object described above.', chr(10)) AS usr FROM dealt GROUP BY level, cluster, part""",
    }


def _report_prompts(spark, sf, part_lines=REPORT_LINES):
    return rp.report_prompts(communities_v(spark, sf), entities(spark, sf), relationships(spark, sf), part_lines)


@register("report_prompts", with_views("rel_v", "entities_v", **REPORT) + "SELECT level, cluster, length(usr) AS chars, sha256(usr) AS user_hash FROM rprompts")
def report_prompts(spark, sf):
    return _report_prompts(spark, sf).select("level", "cluster", F.length("user").alias("chars"), F.sha2("user", 256).alias("user_hash"))


@register(
    "report_parts",
    with_views("rel_v", "entities_v", **REPORT,
        n="""SELECT level, cluster, sum(c) AS lines FROM (SELECT level, cluster, count(*) AS c FROM comm JOIN entities_v USING (entity_id) GROUP BY ALL
             UNION ALL SELECT a.level, a.cluster, count(*) FROM m JOIN comm a ON a.entity_id = source_id JOIN comm b ON b.entity_id = target_id AND b.level = a.level
             AND b.cluster = a.cluster GROUP BY ALL) x GROUP BY level, cluster""")
    + "SELECT level, cluster, ceil(lines / 500)::INT AS parts, lines FROM n",
)
def report_parts(spark, sf):
    """Large communities in parts of about 500 lines: no line is lost."""
    p = rp.report_prompts(communities_v(spark, sf), entities(spark, sf), relationships(spark, sf), part_lines=500)
    lines = F.size(F.filter(F.split("user", "\n"), lambda x: F.startswith(x, F.lit("- "))))
    return p.groupBy("level", "cluster").agg(F.max("parts").alias("parts"), F.sum(lines).alias("lines"))


REPORT_JSON = """CASE WHEN cluster % 7 = 3 THEN 'no report' WHEN cluster % 7 = 5 THEN concat('Sure: {"summary": "about ', cluster, '", "rating": "high"} ok')
   ELSE concat('{"title": " Group ', cluster, '", "summary": "members of ', cluster, ' in level ', level, '", "rating": ', cluster % 10, '.5}') END"""


@register(
    "parse_reports",
    with_views(**{"comm": COMMUNITIES, "a": f"SELECT DISTINCT level, cluster, {REPORT_JSON} AS response FROM comm"})
    + """SELECT level, cluster, CASE WHEN cluster % 7 IN (3, 5) THEN 'Untitled community' ELSE concat('Group ', cluster) END AS title,
         CASE WHEN cluster % 7 = 3 THEN '' WHEN cluster % 7 = 5 THEN concat('about ', cluster) ELSE concat('members of ', cluster, ' in level ', level) END AS summary,
         CASE WHEN cluster % 7 IN (3, 5) THEN 5.0 ELSE cluster % 10 + 0.5 END AS rating, response AS full_content FROM a""",
)
def parse_reports(spark, sf):
    a = communities_v(spark, sf).select("level", "cluster").distinct().withColumn("response", F.expr(REPORT_JSON))
    return rp.parse_reports(a)


@register("upsert_reports")
def upsert_reports(spark, sf):
    from ..operators.completions import with_cache_key

    prompts = with_cache_key(rp.report_prompts(communities_v(spark, sf), entities(spark, sf), relationships(spark, sf)))
    cache = prompts.select("cache_key", F.expr(REPORT_JSON).alias("response"))
    return rp.upsert_reports(communities_v(spark, sf), entities(spark, sf), relationships(spark, sf), None, cut(cache))[0]
