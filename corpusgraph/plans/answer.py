"""Answering a table of questions in one of the retrieval modes.

Retrieval is joins; answers come from completion tables.  Long results (reached
entities, citations) are rows, not arrays.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from ..operators.completions import Completer, complete, with_cache_key
from ..operators.edges import global_row_number
from ..operators.hybrid import blend, candidate_limit
from ..operators.merge import first_named, report_id, units_for_entities
from ..operators.postings import best_documents, bm25, build_postings, corpus_stats
from ..operators.reports import number_text, outer_object
from ..operators.substrings import holders
from ..operators.traverse import k_hop, spread
from ..operators.vectors import cosine, hash_embed, nearest
from ..session import cut

# Limits of the retrieval modes.
SEED_LIMIT = 5
LOCAL_HOPS = 2
CONTEXT_CHARS = 6000
CONTEXT_ROWS = 10
BATCH_SIZE = 5
TOP_POINTS = 10
DRIFT_REPORTS = 5
DRIFT_FOLLOW_UPS = 3
PAGE_CHARS = 2000
GRAPH_MODES = ("global", "local", "drift", "activation")
OVERVIEW_WORDS = ("overview", "summary", "summarize", "overall", "in general", "across the vault")
NO_ENTITIES = "No graph entities matched this question yet."
NO_REPORTS = "No community reports are available yet -- run community/report generation first."


class Graph(NamedTuple):
    """Tables the graph modes read; ``entity_vectors`` may be None (no embedder)."""

    entities: DataFrame
    relationships: DataFrame
    units: DataFrame
    text_unit_entities: DataFrame
    claims: DataFrame
    postings: DataFrame
    stats: DataFrame
    entity_vectors: DataFrame | None = None
    reports: DataFrame | None = None
    report_vectors: DataFrame | None = None


class Answers(NamedTuple):
    """``answers(question_id, text, mode, used_model)``, ``citations(question_id, pos, title)``,
    ``details`` (mode-specific rows) and the new cache."""

    answers: DataFrame
    citations: DataFrame
    details: DataFrame
    cache: DataFrame


def entity_docs(entities: DataFrame) -> DataFrame:
    return entities.select(F.col("entity_id").alias("doc_id"), "title", F.col("description").alias("body"))


def entity_index(entities: DataFrame, analyzer: str = "plain") -> tuple[DataFrame, DataFrame]:
    docs = entity_docs(entities)
    postings = cut(build_postings(docs, analyzer))
    return postings, corpus_stats(docs, postings)


def question_vectors(questions: DataFrame) -> DataFrame:
    return hash_embed(questions, "question_id", "text")


def seed_entities(questions: DataFrame, graph: Graph, limit: int = SEED_LIMIT, analyzer: str = "plain") -> DataFrame:
    """``(question_id, entity_id, value, rank)``: best entities by blended score."""
    hits = bm25(questions, graph.postings, graph.stats, candidate_limit(limit), analyzer)
    if graph.entity_vectors is not None:
        vectors = graph.entity_vectors.select(F.col("entity_id").alias("doc_id"), "vector")
        hits = blend(hits, question_vectors(questions), vectors, limit)
    return hits.where(F.col("rank") <= limit).select(
        "question_id", F.col("doc_id").alias("entity_id"), F.col("score").alias("value"), "rank"
    )


def gather_context(wanted: DataFrame, graph: Graph, max_chars: int = CONTEXT_CHARS) -> DataFrame:
    """``(question_id, context)`` from ``wanted(question_id, entity_id)``.

    Entity lines by id, then up to ten text units and ten claims.  A line has at
    least 15 characters with its break, so only as many entities as could fit are read.
    """
    fit = max_chars // 15 + 1
    by_id = Window.partitionBy("question_id").orderBy("entity_id")
    ids = cut(wanted.select("question_id", "entity_id").distinct())
    first = (
        ids.join(graph.entities.select("entity_id"), "entity_id", "left_semi")
        .withColumn("nth", F.row_number().over(by_id))
        .where(F.col("nth") <= fit)
    )
    entity_lines = first.join(graph.entities, "entity_id").select(
        "question_id", F.lit(0).alias("block"), "nth",
        F.concat(F.lit("Entity: "), F.col("title"), F.lit(" ("), F.col("type"), F.lit(") -- "), F.col("description")).alias("line"),
    )
    units = units_for_entities(ids, graph.text_unit_entities, graph.units, CONTEXT_ROWS)
    unit_lines = units.select(
        "question_id", F.lit(1).alias("block"), "nth",
        F.concat(F.lit("Text unit ("), F.col("page_path"), F.lit("#"), F.col("chunk_index").cast("string"), F.lit("): "), F.col("text")).alias("line"),
    )
    # an entity's first claims are all that it can bring
    named = graph.claims.withColumn("entity_id", F.explode(F.array_compact(F.array_distinct(F.array("subject_id", "object_id")))))
    own = (
        named.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")
        .withColumn("nth", F.row_number().over(Window.partitionBy("entity_id").orderBy("claim_id")))
        .where(F.col("nth") <= CONTEXT_ROWS).drop("nth")
    )
    touching = first_named(ids, own.select("entity_id", "claim_id", "status", "type", "description"), ("claim_id",), CONTEXT_ROWS)
    claim_lines = touching.select(
        "question_id", F.lit(2).alias("block"), "nth",
        F.concat(F.lit("Claim ("), F.col("status"), F.lit(", "), F.col("type"), F.lit("): "), F.col("description")).alias("line"),
    )
    rows = entity_lines.unionByName(unit_lines).unionByName(claim_lines)
    return rows.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("block", "nth", "line"))).alias("l")).select(
        "question_id", F.substring(F.array_join(F.transform("l", lambda s: s["line"]), "\n"), 1, max_chars).alias("context")
    )


def _answer_system(mode: str) -> str:
    return (
        f"Answer the question in {mode} retrieval mode from the graph context only. "
        'Answer with one JSON object {"answer": text, "citations": [titles]}.'
    )


def answer_prompts(questions: DataFrame, contexts: DataFrame, mode: str) -> DataFrame:
    user = F.concat(
        F.lit("Graph context:\n"), F.coalesce(F.nullif(F.col("context"), F.lit("")), F.lit("(no context retrieved)")),
        F.lit("\n\nQuestion:\n"), F.col("text"),
    )
    return questions.join(contexts, "question_id").select(
        "question_id", F.lit(_answer_system(mode)).alias("system"), user.alias("user")
    )


def parse_answer_object(response: Column, field: str = "answer") -> tuple[Column, Column]:
    """Answer text (raw text when the JSON is bad or empty) and its list of citations."""
    v = F.try_parse_json(outer_object(response))
    text = tx.strip(F.try_variant_get(v, f"$.{field}", "string"))
    raw = tx.strip(response)
    cites = F.filter(F.try_variant_get(v, "$.citations", "array<string>"), lambda c: c.isNotNull() & (tx.strip(c) != ""))
    return F.when(F.coalesce(text, F.lit("")) == "", raw).otherwise(text), F.coalesce(cites, F.array().cast("array<string>"))


def _finish(
    questions: DataFrame, reached: DataFrame, graph: Graph, mode: str, label: str,
    cache: DataFrame, completer: Completer | None, model: str,
) -> Answers:
    """Context, prompt and answer for questions with reached entities; a fixed message for the others."""
    reached = cut(reached)
    prompts = answer_prompts(questions, gather_context(reached, graph), label)
    done = complete(with_cache_key(prompts, model), cache, completer)
    text, cites = parse_answer_object(F.col("response"))
    asked = cut(done.answered.where("response is not null").select("question_id", text.alias("text"), cites.alias("cites")))
    silent = questions.select("question_id").join(reached.select("question_id").distinct(), "question_id", "left_anti")
    answers = asked.select("question_id", "text", F.lit(mode).alias("mode"), F.lit(True).alias("used_model")).unionByName(
        silent.select("question_id", F.lit(NO_ENTITIES).alias("text"), F.lit(mode).alias("mode"), F.lit(False).alias("used_model"))
    )
    given = asked.select("question_id", F.posexplode("cites").alias("pos", "title"))
    titles = (
        reached.join(asked.where(F.size("cites") == 0).select("question_id"), "question_id", "left_semi")
        .join(graph.entities.select("entity_id", "title"), "entity_id")
        .select("question_id", F.col("entity_id").alias("pos"), "title")
    )
    citations = given.select("question_id", F.col("pos").cast("long").alias("pos"), "title").unionByName(
        titles.select("question_id", F.col("pos").cast("long").alias("pos"), "title")
    )
    return Answers(answers, citations, reached, done.cache)


def local_search(
    questions: DataFrame, graph: Graph, cache: DataFrame, completer: Completer | None = None, model: str = "mock",
    hops: int = LOCAL_HOPS, k_seeds: int = SEED_LIMIT,
) -> Answers:
    """Seeds, their neighbourhood, context, answer."""
    seeds = cut(seed_entities(questions, graph, k_seeds))
    reached = k_hop(graph.relationships, graph.entities, seeds, hops)
    return _finish(questions, reached, graph, "local", "local", cache, completer, model)


def activation_search(
    questions: DataFrame, graph: Graph, cache: DataFrame, completer: Completer | None = None, model: str = "mock",
    top_n: int = TOP_POINTS, **spread_options,
) -> Answers:
    """Seeds, spreading activation, the ten strongest entities, context, answer."""
    seeds = cut(seed_entities(questions, graph))
    active = spread(graph.relationships, seeds, **spread_options)
    w = Window.partitionBy("question_id").orderBy(F.desc("activation"), "entity_id")
    best = active.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    return _finish(questions, best, graph, "activation", "spreading-activation", cache, completer, model)


def report_batches(reports: DataFrame, level: int | None = None, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Reports of one level (the deepest by default) in order, five to a batch: ``(batch, block)``."""
    chosen = reports
    wanted = F.lit(level) if level is not None else reports.agg(F.max("level").alias("m")).scalar()
    rows = global_row_number(chosen.where(F.col("level") == wanted), "cluster", name="n")
    text = F.concat(
        F.lit("### "), F.col("title"), F.lit(" (level "), F.col("level").cast("string"), F.lit(", cluster "),
        F.col("cluster").cast("string"), F.lit(")\n"), F.col("summary"),
    )
    return (
        rows.select(F.floor((F.col("n") - 1) / batch_size).cast("long").alias("batch"), "n", text.alias("t"))
        .groupBy("batch")
        .agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("b"))
        .select("batch", F.array_join(F.transform("b", lambda s: s["t"]), "\n\n").alias("block"))
    )


_MAP_SYSTEM = (
    "From the community reports, list key points relevant to the question. "
    'Answer with one JSON array [{"point": text, "score": 0-10}]; [] when nothing is relevant.'
)
_REDUCE_SYSTEM = 'Combine the key points into one answer. Answer with one JSON object {"answer": text}.'
_PRIMER_SYSTEM = (
    "From the community reports, draft an answer and name follow-up questions to look into. "
    'Answer with one JSON object {"draft": text, "follow_ups": [questions]}.'
)


def global_map_prompts(questions: DataFrame, batches: DataFrame) -> DataFrame:
    """One prompt per question and batch; every question is asked of every batch, as the mode defines."""
    n = F.coalesce(batches.agg((F.max("batch") + 1).alias("n")).scalar(), F.lit(0))
    user = F.concat(F.lit("Community reports:\n"), F.col("block"), F.lit("\n\nQuestion:\n"), F.col("text"))
    numbers = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    return (
        questions.select("question_id", "text", F.explode(numbers).alias("batch"))
        .join(batches, "batch")
        .select("question_id", "batch", F.lit(_MAP_SYSTEM).alias("system"), user.alias("user"))
    )


def rated_points(answers: DataFrame) -> DataFrame:
    """``(question_id, batch, pos, point, score)`` from JSON arrays; bad ones give no row."""
    arr = F.regexp_extract("response", r"(?s)\[.*\]", 0)
    items = F.try_variant_get(F.try_parse_json(arr), "$", "array<variant>")
    rows = answers.select("question_id", "batch", F.posexplode(items).alias("pos", "v")).select(
        "question_id", "batch", "pos",
        tx.strip(F.try_variant_get("v", "$.point", "string")).alias("point"),
        F.coalesce(F.try_variant_get("v", "$.score", "string").try_cast("double"), F.lit(0.0)).alias("score"),
    )
    return rows.where(F.coalesce("point", F.lit("")) != "")


def top_points(points: DataFrame, top_n: int = TOP_POINTS) -> DataFrame:
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "batch", "pos")
    return points.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def global_search(
    questions: DataFrame, graph: Graph, cache: DataFrame, completer: Completer | None = None, model: str = "mock",
    level: int | None = None,
) -> Answers:
    """Reports in batches to rated points, the best points to one answer."""
    reports = graph.reports
    wanted = F.lit(level) if level is not None else reports.agg(F.max("level").alias("m")).scalar()
    batches = cut(report_batches(reports, level))
    if batches.isEmpty():
        answers = questions.select(
            "question_id", F.lit(NO_REPORTS).alias("text"), F.lit("global").alias("mode"), F.lit(False).alias("used_model")
        )
        none = questions.select("question_id", F.lit(0).cast("long").alias("pos"), F.lit("").alias("title")).limit(0)
        return Answers(answers, none, none, cache)
    mapped = complete(with_cache_key(global_map_prompts(questions, batches), model), cache, completer)
    best = cut(top_points(rated_points(mapped.answered.where("response is not null"))))
    line = F.concat(F.lit("- ("), F.format_string("%.1f", F.col("score")), F.lit(") "), F.col("point"))
    blocks = best.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    user = F.concat(
        F.lit("Key points:\n"),
        F.coalesce(F.array_join(F.transform("l", lambda s: s["line"]), "\n"), F.lit("(no key points found)")),
        F.lit("\n\nQuestion:\n"), F.col("text"),
    )
    prompts = questions.join(blocks, "question_id", "left").select(
        "question_id", F.lit(_REDUCE_SYSTEM).alias("system"), user.alias("user")
    )
    reduced = complete(with_cache_key(prompts, model), mapped.cache, completer)
    text, _ = parse_answer_object(F.col("response"))
    answers = reduced.answered.where("response is not null").select(
        "question_id", text.alias("text"), F.lit("global").alias("mode"), F.lit(True).alias("used_model")
    )
    # every answer cites all reports of the level: kept once, not once per question
    citations = (
        reports.where((F.col("level") == wanted) & (F.col("title") != ""))
        .select(F.lit(None).cast(questions.schema["question_id"].dataType).alias("question_id"), F.col("cluster").cast("long").alias("pos"), "title")
    )
    return Answers(answers, citations, best, reduced.cache)


def top_reports(questions: DataFrame, graph: Graph, limit: int = DRIFT_REPORTS) -> DataFrame:
    """``(question_id, level, cluster, title, summary, rank)``: by cosine, else by words found in the report.

    Without vectors a report is scored by how many distinct question words occur
    in it as substrings; reports without any such word still fill up the list.  With
    vectors, a report that has none counts as a cosine of 0.
    """
    reports = graph.reports
    if graph.report_vectors is not None:
        known = reports.withColumn("report_id", report_id(F.col("level"), F.col("cluster")))
        best = nearest(
            question_vectors(questions), graph.report_vectors.select(F.col("report_id").alias("doc_id"), "vector"), limit
        ).select("question_id", F.col("doc_id").alias("report_id"), "cosine")
        bare = known.join(graph.report_vectors.select("report_id"), "report_id", "left_anti").orderBy("level", "cluster").limit(limit)
        # at most ``limit`` ids for every question
        fill = F.array(*[F.lit(r["report_id"]) for r in bare.select("report_id").collect()]).cast("array<bigint>")
        filled = questions.select("question_id", F.explode(fill).alias("report_id"), F.lit(0.0).alias("cosine"))
        in_order = Window.partitionBy("question_id").orderBy(F.desc("cosine"), "level", "cluster")
        ranked = best.unionByName(filled).join(known, "report_id").withColumn("rank", F.row_number().over(in_order))
        return ranked.where(F.col("rank") <= limit).drop("cosine")
    return _lexical_reports(questions, reports, limit)


def _lexical_reports(questions: DataFrame, reports: DataFrame, limit: int) -> DataFrame:
    """Words are found by the gram index; scores are summed, and the best of each part taken, where the found words of a report lie."""
    report = F.struct("level", "cluster").alias("doc_id")
    texts = reports.select(report, F.lower(F.concat_ws(" ", "title", "summary")).alias("text"))
    asked = cut(questions.select("question_id", F.explode(F.array_distinct(tx.words(F.lower("text")))).alias("term")))
    dealt = holders(asked.select("term"), texts).withColumn("impact", F.lit(1.0)).repartition("doc_id")
    weights = asked.select(
        "question_id", "term", F.lit(1.0).alias("w"), F.lit(None).cast("double").alias("floor"), F.lit(True).alias("essential"), F.lit(0.0).alias("rest")
    )
    matched = best_documents(dealt, weights, limit).select("question_id", "doc_id.level", "doc_id.cluster", F.col("score").cast("long").alias("score"))
    matched = cut(matched)
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "level", "cluster")
    # reports without a match follow in listing order; the first ``limit`` of them suffice
    head = reports.orderBy("level", "cluster").limit(2 * limit).select("level", "cluster")
    listing = head.agg(F.array_sort(F.collect_list(F.struct("level", "cluster"))).alias("l")).scalar()
    fill = (
        questions.select("question_id", F.posexplode(listing).alias("n", "r"))
        .select("question_id", "n", "r.level", "r.cluster")
        .join(matched, ["question_id", "level", "cluster"], "left_anti")
        .withColumn("score", F.lit(0).cast("long"))
    )
    both = matched.unionByName(fill.select("question_id", "level", "cluster", "score"))
    ranked = both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return ranked.drop("score").join(reports, ["level", "cluster"])


def drift_search(
    questions: DataFrame, graph: Graph, cache: DataFrame, completer: Completer | None = None, model: str = "mock",
    k_reports: int = DRIFT_REPORTS, max_follow_ups: int = DRIFT_FOLLOW_UPS, hops: int = 1,
) -> Answers:
    """Best reports to a draft and follow-ups; each follow-up is one more local question.

    ``details`` holds the question tree ``(question_id, n, question, answer)``.
    """
    best = cut(top_reports(questions, graph, k_reports))
    block = F.concat(F.lit("### "), F.col("title"), F.lit("\n"), F.col("summary"))
    blocks = best.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("l"))
    user = F.concat(
        F.lit("Community reports:\n"), F.array_join(F.transform("l", lambda s: s["b"]), "\n\n"), F.lit("\n\nQuestion:\n"), F.col("text")
    )
    prompts = questions.join(blocks, "question_id").select("question_id", F.lit(_PRIMER_SYSTEM).alias("system"), user.alias("user"))
    primed = complete(with_cache_key(prompts, model), cache, completer)
    draft, _ = parse_answer_object(F.col("response"), "draft")
    v = F.try_parse_json(outer_object(F.col("response")))
    asks = F.filter(F.transform(F.try_variant_get(v, "$.follow_ups", "array<string>"), tx.strip), lambda q: q != "")
    asks = F.slice(F.coalesce(asks, F.array().cast("array<string>")), 1, max_follow_ups)
    primer = cut(primed.answered.where("response is not null").select("question_id", draft.alias("draft"), asks.alias("asks")))
    follow = cut(
        primer.select("question_id", F.posexplode("asks").alias("n", "question")).select(
            F.xxhash64("question_id", "n").alias("follow_id"), "question_id", "n", "question"
        )
    )
    sub = local_search(
        follow.select(F.col("follow_id").alias("question_id"), F.col("question").alias("text")), graph, primed.cache, completer, model, hops
    )
    tree = cut(
        follow.join(sub.answers.select(F.col("question_id").alias("follow_id"), F.col("text").alias("answer")), "follow_id").select(
            "question_id", "n", "question", "answer"
        )
    )
    qa = F.concat(F.lit("Q: "), F.col("question"), F.lit("\nA: "), F.col("answer"))
    told = tree.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("n", qa.alias("t")))).alias("l")).select(
        "question_id", F.array_join(F.transform("l", lambda s: s["t"]), "\n").alias("qa")
    )
    text = F.when(F.col("qa").isNull(), F.col("draft")).otherwise(F.concat("draft", F.lit("\n\n"), "qa"))
    silent = questions.select("question_id").join(best.select("question_id").distinct(), "question_id", "left_anti")
    answers = primer.join(told, "question_id", "left").select(
        "question_id", text.alias("text"), F.lit("drift").alias("mode"), F.lit(True).alias("used_model")
    ).unionByName(
        silent.select("question_id", F.lit(NO_REPORTS).alias("text"), F.lit("drift").alias("mode"), F.lit(False).alias("used_model"))
    )
    cited = best.select("question_id", F.lit(-1).alias("n"), F.col("rank").cast("long").alias("pos"), "title").unionByName(
        sub.citations.withColumnRenamed("question_id", "follow_id")
        .join(follow.select("follow_id", "question_id", "n"), "follow_id")
        .select("question_id", "n", "pos", "title")
    )
    first = cited.groupBy("question_id", "title").agg(F.min(F.struct("n", "pos")).alias("at"))
    in_order = Window.partitionBy("question_id").orderBy("at.n", "at.pos", "title")
    citations = first.select("question_id", F.row_number().over(in_order).cast("long").alias("pos"), "title")
    return Answers(answers, citations, tree, sub.cache)


def resolve_mode(questions: DataFrame, has_graph: bool) -> DataFrame:
    """Add ``resolved``: one of the graph modes or ``legacy``; an unknown mode raises when evaluated."""
    lowered = F.lower("text")
    broad = F.lit(False)
    for word in OVERVIEW_WORDS:
        broad = broad | F.contains(lowered, F.lit(word))
    auto = F.when(F.lit(not has_graph), F.lit("legacy")).when(broad, F.lit("global")).otherwise(F.lit("local"))
    m = F.col("mode")
    return questions.withColumn(
        "resolved",
        F.when(m.isNull() | (m == "legacy"), F.lit("legacy"))
        .when(m == "auto", auto)
        .when(m.isin(*GRAPH_MODES), m)
        .otherwise(F.raise_error(F.concat(F.lit("unknown query mode "), m)).cast("string")),
    )


def page_prompts(questions: DataFrame, hits: DataFrame, pages: DataFrame, recent: str = "") -> DataFrame:
    """Answer prompts over retrieved pages, each body cut at 2,000 characters."""
    block = F.concat(
        F.lit("### [["), F.col("title"), F.lit("]] (`"), F.col("page_path"), F.lit("`)\n\n"), F.substring("body", 1, PAGE_CHARS)
    )
    found = hits.select("question_id", F.col("doc_id").alias("page_path"), "rank").join(
        pages.select("page_path", "title", "body"), "page_path"
    )
    blocks = found.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("l"))
    text = F.coalesce(F.array_join(F.transform("l", lambda s: s["b"]), "\n\n"), F.lit("(no pages retrieved)"))
    user = F.concat(
        F.lit("## Recent context\n\n" + (recent.strip() or "(empty)") + "\n\n## Retrieved pages\n\n"), text,
        F.lit("\n\n## Question\n\n"), F.col("text"), F.lit("\n"),
    )
    system = "Answer from the supplied pages only and cite each page used as [[Title]]; say so when they do not suffice."
    return questions.join(blocks, "question_id", "left").select("question_id", F.lit(system).alias("system"), user.alias("user"))


def page_answers(
    questions: DataFrame, hits: DataFrame, pages: DataFrame, cache: DataFrame, completer: Completer | None = None,
    model: str = "mock", recent: str = "",
) -> Answers:
    """Answers over page hits; a question without a completion keeps its hits and is marked as an error.

    ``details`` are the hits.  Citations are those the answer lists, else its links.
    """
    done = complete(with_cache_key(page_prompts(questions, hits, pages, recent), model), cache, completer)
    text, cites = parse_answer_object(F.col("response"))
    linked = F.regexp_extract_all(F.col("text"), F.lit(tx.LINK_PATTERN), F.lit(1))
    rows = done.answered.select(
        "question_id", F.when(F.col("response").isNull(), F.lit("answer unavailable")).otherwise(text).alias("text"),
        F.when(F.col("response").isNull(), F.array().cast("array<string>")).otherwise(cites).alias("cites"),
        F.col("response").isNotNull().alias("used_model"),
    )
    answers = rows.select("question_id", "text", F.lit("legacy").alias("mode"), "used_model")
    citations = rows.where("used_model").select(
        "question_id", F.posexplode(F.when(F.size("cites") > 0, F.col("cites")).otherwise(linked)).alias("pos", "title")
    ).select("question_id", F.col("pos").cast("long").alias("pos"), "title")
    return Answers(answers, citations, hits, done.cache)


class Dispatched(NamedTuple):
    """Answers of all modes, their citations ``(question_id, pos, title)``, the rows behind them by mode, and one cache."""

    answers: DataFrame
    citations: DataFrame
    details: dict[str, DataFrame]
    cache: DataFrame


def answer(
    questions: DataFrame, graph: Graph, page_hits, pages: DataFrame, cache: DataFrame, completer: Completer | None = None,
    model: str = "mock", recent: str = "",
) -> Dispatched:
    """``questions(question_id, text, mode)`` through their modes.

    ``page_hits`` is a function from questions to page hits, used for legacy questions.
    Every mode starts from the cache that the one before it left, so no completion is asked for twice.
    """
    resolved = cut(resolve_mode(questions, not graph.entities.isEmpty()))
    used = {r["resolved"] for r in resolved.select("resolved").distinct().collect()}  # at most five values
    runs = {
        "local": lambda q, c: local_search(q, graph, c, completer, model),
        "activation": lambda q, c: activation_search(q, graph, c, completer, model),
        "global": lambda q, c: global_search(q, graph, c, completer, model),
        "drift": lambda q, c: drift_search(q, graph, c, completer, model),
        "legacy": lambda q, c: page_answers(q, page_hits(q), pages, c, completer, model, recent),
    }
    schema = f"question_id {questions.schema['question_id'].dataType.simpleString()}, "
    spark = questions.sparkSession
    answers = spark.createDataFrame([], schema + "text string, mode string, used_model boolean")
    citations = spark.createDataFrame([], schema + "pos bigint, title string")
    details = {}
    for mode in sorted(used):
        part = runs[mode](resolved.where(F.col("resolved") == mode).select("question_id", "text"), cache)
        answers, citations = answers.unionByName(part.answers), citations.unionByName(part.citations)
        details[mode], cache = part.details, cut(part.cache)
    return Dispatched(answers, citations, details, cache)
