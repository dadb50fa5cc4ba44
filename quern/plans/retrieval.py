"""Queries of search and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import filters, retrieve, search
from quern.sources import load

from .registry import query

#: The identity and the request that the single-request queries use.
TENANT, DEPARTMENT, LEVEL, REQUEST = "tenant-fjord", "claims", "confidential", 20
_VISIBLE = "tenant_id = 'tenant-fjord' AND status = 'active' AND access_level IN ('public', 'internal', 'confidential') AND department IN ('claims', 'global')"
_CHUNKS = "(SELECT DISTINCT id, document_id, parent_key, knowledge_base_id, tenant_id, content, doc_type, department, access_level, status, source_uri, page_start, page_end FROM rag_chunks)"
_SQUASH = r"trim(regexp_replace(@@, '[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))"
_CAND = """c AS (SELECT request_id, chunk_id, max(tenant_id) AS tenant_id, max(parent_key) AS parent_key, max(CASE WHEN NOT isnan(vector_score) THEN vector_score END) AS s, max(final_top_k) AS k
  FROM ranked_candidates GROUP BY request_id, chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY s DESC, chunk_id) AS rank FROM c WHERE s IS NOT NULL),
f AS (SELECT * FROM r WHERE rank <= k)"""


def _chunks(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    columns = ["id", "document_id", "parent_key", "knowledge_base_id", "tenant_id", "doc_type", "department", "access_level", "status", *more]
    return load(spark, folder, "rag_chunks", *columns).distinct()


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "vector_chunks", "chunk_id", "embedding", "embedding_model", "embedding_dim").where(search.usable("embedding", "embedding_dim"))
    return rows.where("embedding_model = 'text-embed-64'").select("chunk_id", "embedding")


_VECTORS = """(SELECT DISTINCT chunk_id, embedding::DOUBLE[] AS e FROM vector_chunks WHERE embedding_model = 'text-embed-64' AND embedding IS NOT NULL AND len(embedding) = embedding_dim
  AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)))"""


def _parents(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of parents by key, with the tenant and the status of their document."""
    owners = load(spark, folder, "rag_documents", "package_id", "tenant_id", "status").withColumnRenamed("package_id", "document_id")
    rows = load(spark, folder, "parent_chunks", "parent_id", "document_id", "text").join(owners, "document_id")
    return rows.groupBy(F.col("parent_id").alias("parent_key"), "tenant_id", "status").agg(F.max("text").alias("parent_text"))


def _finals(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of every request once, ranked by vector score, the first final_top_k."""
    rows = load(spark, folder, "ranked_candidates", "request_id", "tenant_id", "chunk_id", "parent_key", "vector_score", "final_top_k")
    once = rows.groupBy("request_id", "chunk_id").agg(F.max("tenant_id").alias("tenant_id"), F.max("parent_key").alias("parent_key"), F.max(F.when(~F.isnan("vector_score"), F.col("vector_score"))).alias("score"), F.max("final_top_k").alias("k"))
    return retrieve.ranked(once, "request_id", "chunk_id", "score", F.col("k"))


@query(f"SELECT id, knowledge_base_id, doc_type FROM {_CHUNKS} WHERE {_VISIBLE}")
def permission_closure(spark, folder):
    return _chunks(spark, folder).where(filters.visible(TENANT, DEPARTMENT, LEVEL)).select("id", "knowledge_base_id", "doc_type").distinct()


@query(f"""SELECT l.level, count(*) FILTER (WHERE NOT CASE l.level WHEN 'public' THEN access_level = 'public' WHEN 'internal' THEN access_level IN ('public', 'internal')
  WHEN 'confidential' THEN access_level <> 'restricted' ELSE true END) AS hidden FROM {_CHUNKS} c, (VALUES ('public'), ('internal'), ('confidential'), ('restricted')) l(level) WHERE status = 'active' GROUP BY 1""")
def hidden_by_level(spark, folder):
    rows = _chunks(spark, folder).where("status = 'active'").agg(*(F.count_if(~filters.one_of("access_level", READ)).alias(level) for level, READ in filters.READABLE.items()))
    return rows.select(F.explode(F.map_from_arrays(F.array(*(F.lit(x) for x in filters.READABLE)), F.array(*filters.READABLE))).alias("level", "hidden"))


@query("SELECT id FROM rag_chunks WHERE false")
def empty_list_filter(spark, folder):
    return load(spark, folder, "rag_chunks").where(filters.visible(TENANT, DEPARTMENT, LEVEL, {"knowledge_base_ids": []})).select("id")


@query("SELECT id, title FROM rag_documents WHERE title ILIKE '%report%' OR source_name ILIKE '%report%' OR source_uri ILIKE '%report%' OR title ILIKE '%premium%' OR source_name ILIKE '%premium%' OR source_uri ILIKE '%premium%'")
def document_search(spark, folder):
    where = filters.contains_text("report", ("title", "source_name", "source_uri")) | filters.contains_text("premium", ("title", "source_name", "source_uri"))
    return load(spark, folder, "rag_documents", "id", "title", "source_name", "source_uri").where(where).select("id", "title")


@query("""SELECT vec_id, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM (SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 20) q) ORDER BY s DESC, vec_id LIMIT 10""")
def vector_topk(spark, folder):
    rows = load(spark, folder, "embeddings", "vec_id", "embedding")
    request = rows.where(F.col("vec_id") == REQUEST).select("embedding").first()[0]  # one vector
    return search.nearest(rows, "vec_id", "embedding", request, 10).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("bigint"))


@query("""SELECT request, vec_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY s DESC, vec_id) AS rank FROM (SELECT q.vec_id AS request, e.vec_id,
  list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id)) WHERE rank <= 10""")
def vector_topk_each(spark, folder):
    rows = load(spark, folder, "embeddings", "vec_id", "embedding")
    found = search.nearest_for_each(rows, "vec_id", "embedding", rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 10)
    return found.select("request", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH q AS (SELECT e FROM {_VECTORS} ORDER BY chunk_id LIMIT 1), s AS (SELECT v.chunk_id, list_cosine_similarity(v.e, q.e) AS s FROM {_VECTORS} v JOIN {_CHUNKS} c ON c.id = v.chunk_id, q WHERE {_VISIBLE})
SELECT chunk_id, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, chunk_id) AS rank FROM (SELECT DISTINCT * FROM s) ORDER BY s DESC, chunk_id LIMIT 10""")
def vector_topk_visible(spark, folder):
    vectors = _vectors(spark, folder)
    request = vectors.orderBy("chunk_id").select("embedding").first()  # one vector
    shown = load(spark, folder, "rag_chunks", "id", "tenant_id", "department", "access_level", "status").where(filters.visible(TENANT, DEPARTMENT, LEVEL)).select(F.col("id").alias("chunk_id"))
    found = search.nearest(vectors.join(shown, "chunk_id", "left_semi"), "chunk_id", "embedding", request[0] if request else [], 10, repeated=True)
    return found.withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("bigint"))


_LEX = r"list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@query(f"SELECT DISTINCT id FROM rag_chunks WHERE status = 'active' AND list_has_all({_LEX}, ['annual', 'budget'])")
def fulltext_match(spark, folder):
    return search.full_text(load(spark, folder, "rag_chunks", "id", "content", "status").where("status = 'active'"), "id", "content", "Annual budget").select("id").distinct()


@query(f"""WITH t AS (SELECT DISTINCT id, {_LEX} AS t FROM rag_chunks WHERE status = 'active'), w AS (SELECT id, t[i::BIGINT] AS word, i FROM t, unnest(range(1, len(t) + 1)) AS u(i))
SELECT a.id, round(2.0::DOUBLE / (min(abs(a.i - b.i)) + 1), 6) AS score FROM w a JOIN w b ON a.id = b.id AND a.word = 'annual' AND b.word = 'budget' GROUP BY a.id ORDER BY score DESC, a.id LIMIT 20""")
def fulltext_rank(spark, folder):
    rows = load(spark, folder, "rag_chunks", "id", "content", "status").where("status = 'active'").select("id", "content").distinct()
    return search.full_text(rows, "id", "content", "annual budget", 20).withColumn("score", F.round("score", 6))


@query(f"WITH {_CAND} SELECT request_id, chunk_id, s AS score, rank FROM f")
def vector_fallback_rank(spark, folder):
    return _finals(spark, folder).select("request_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("""WITH c AS (SELECT DISTINCT request_id, chunk_id, rerank_score AS s FROM ranked_candidates WHERE rerank_score IS NOT NULL AND NOT isnan(rerank_score)),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY s DESC, chunk_id) AS n FROM c),
a AS (SELECT request_id, max(CASE WHEN n = 1 THEN s END) AS t1, max(CASE WHEN n = 2 THEN s END) AS t2, (count(*) FILTER (WHERE s >= 0.35))::INT AS above FROM r GROUP BY 1)
SELECT q.request_id, t1 IS NULL OR t1 < 0.35 AS refuse, CASE WHEN t1 IS NULL THEN 'no_candidates' WHEN t1 < 0.35 THEN 'low_confidence' END AS reason,
  CASE WHEN t1 IS NULL THEN 'none' WHEN t1 < 0.35 THEN 'low' WHEN t1 - t2 < 0.05 THEN 'medium' ELSE 'high' END AS confidence, t1 AS top1, round(t1 - t2, 6) AS margin, coalesce(above, 0) AS above
FROM (SELECT DISTINCT request_id FROM ranked_candidates) q LEFT JOIN a USING (request_id)""")
def refusal_decision(spark, folder):
    rows = load(spark, folder, "ranked_candidates", "request_id", "chunk_id", "rerank_score").distinct()
    return retrieve.refusal(retrieve.ranked(rows, "request_id", "chunk_id", "rerank_score"), "request_id", "rerank_score", rows).withColumn("margin", F.round("margin", 6))


def _expanded(spark: SparkSession, folder: str) -> DataFrame:
    parents = _parents(spark, folder)
    return retrieve.expand_parents(_finals(spark, folder), parents, "request_id", "score")


_EXP = f"""{_CAND}, p AS (SELECT parent_id AS parent_key, d.tenant_id, max(text) AS parent_text FROM parent_chunks JOIN rag_documents d ON d.package_id = document_id WHERE d.status = 'active' GROUP BY 1, 2),
x AS (SELECT request_id, parent_key, tenant_id, arg_max(chunk_id, [s, -chunk_id]) AS chunk_id, max(s) AS score, list(chunk_id ORDER BY rank) AS children FROM f GROUP BY 1, 2, 3),
e AS (SELECT x.*, p.parent_text, p.parent_text IS NULL AS parent_missing FROM x LEFT JOIN p USING (parent_key, tenant_id))"""


@query(f"WITH {_EXP} SELECT request_id, parent_key, chunk_id, score, array_to_string(children, ',') AS children, parent_missing FROM e")
def parent_expansion(spark, folder):
    return _expanded(spark, folder).select("request_id", "parent_key", "chunk_id", "score", F.array_join(F.col("children").cast("array<string>"), ",").alias("children"), "parent_missing")


@query(f"WITH {_EXP} SELECT request_id, parent_key, chunk_id, '[' || row_number() OVER (PARTITION BY request_id ORDER BY score DESC, chunk_id) || ']' AS ref_id FROM e")
def reference_numbers(spark, folder):
    return retrieve.references(_expanded(spark, folder), "request_id").select("request_id", "parent_key", "chunk_id", "ref_id")


_CONTENT, _QUESTION = _SQUASH.replace("@@", "content"), _SQUASH.replace("@@", "coalesce(question, '')")
_SNIP = f"CASE WHEN length({_CONTENT}) <= 360 THEN {_CONTENT} ELSE rtrim(substr({_CONTENT}, 1, 360)) || '...' END"


@query(f"WITH {_CAND}, t AS (SELECT id, any_value(content) AS content FROM rag_chunks GROUP BY 1) SELECT request_id, chunk_id, rank, {_SNIP} AS snippet FROM f JOIN t ON t.id = f.chunk_id")
def hit_summary(spark, folder):
    chunks = load(spark, folder, "rag_chunks", "id", "content").distinct()
    return retrieve.summaries(_finals(spark, folder), chunks).select("request_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), "snippet")


@query(f"WITH {_CAND} SELECT r.request_id, r.chunk_id, f.chunk_id IS NOT NULL AS selected FROM r LEFT JOIN f ON f.request_id = r.request_id AND f.chunk_id = r.chunk_id")
def selected_flag(spark, folder):
    rows = load(spark, folder, "ranked_candidates", "request_id", "chunk_id", "vector_score").where("vector_score is not null and not isnan(vector_score)").select("request_id", "chunk_id").distinct()
    return rows.join(_finals(spark, folder).select("request_id", "chunk_id", F.lit(True).alias("selected")), ["request_id", "chunk_id"], "left").select("request_id", "chunk_id", F.coalesce("selected", F.lit(False)).alias("selected"))


_EST = r"(len(regexp_extract_all(coalesce({0}, ''), '[\x{{4e00}}-\x{{9fff}}\x{{3400}}-\x{{4dbf}}\x{{f900}}-\x{{faff}}\x{{20000}}-\x{{2a6df}}]')) + floor(1.3::DOUBLE * len(regexp_extract_all(coalesce({0}, ''), '[a-zA-Z0-9]+(?:[-''][a-zA-Z0-9]+)*'))))::BIGINT"


@query(f"""WITH RECURSIVE {_EXP}, t AS (SELECT id, any_value(content) AS content FROM rag_chunks GROUP BY 1),
n AS (SELECT e.request_id, row_number() OVER (PARTITION BY e.request_id ORDER BY score DESC, e.chunk_id) AS ref, {_EST.format('e.parent_text')} + {_EST.format('t.content')} AS whole, {_EST.format('t.content')} AS small
  FROM e JOIN t ON t.id = e.chunk_id),
w AS (SELECT request_id, 0::BIGINT AS ref, NULL::VARCHAR AS form, 0::BIGINT AS used FROM n GROUP BY 1
  UNION ALL SELECT n.request_id, n.ref, CASE WHEN w.used + whole <= 2000 THEN 'full' WHEN w.used + small <= 2000 THEN 'compact' END,
    CASE WHEN w.used + whole <= 2000 THEN w.used + whole WHEN w.used + small <= 2000 THEN w.used + small ELSE w.used END FROM w JOIN n ON n.request_id = w.request_id AND n.ref = w.ref + 1)
SELECT request_id, ref, form, used FROM w WHERE form IS NOT NULL""")
def context_budget(spark, folder):
    chunks = load(spark, folder, "rag_chunks", "id", "content").distinct().select(F.col("id").alias("chunk_id"), T.token_estimate(F.col("content")).alias("small"))
    rows = _expanded(spark, folder).select("request_id", "chunk_id", "score", T.token_estimate(F.col("parent_text")).alias("parent")).join(chunks, "chunk_id")
    numbered = retrieve.references(rows, "request_id").withColumn("whole", F.col("parent") + F.col("small")).withColumn("ref", F.col("ref").cast("bigint"))
    return retrieve.within_budget(numbered, "request_id", "ref", "whole", "small", 2000)


@query()
def context_text(spark, folder):
    """Whole contexts: the blocks of each request's references within the budget."""
    chunks = load(spark, folder, "rag_chunks", "id", "content", "source_uri", "doc_type", "page_start", "page_end", "heading_path").dropDuplicates(["id"]).withColumnRenamed("id", "chunk_id")
    places = _finals(spark, folder).select("request_id", "chunk_id", "rank")  # the order of the vectors
    rows = retrieve.references(_expanded(spark, folder), "request_id").join(chunks, "chunk_id").join(places, ["request_id", "chunk_id"])
    parent = retrieve.parent_window(F.col("parent_text"), F.lit(None).cast("int"), F.col("content"), F.col("rank"), F.size("children"))
    args = [F.col(c) for c in ("ref_id", "source_uri", "page_start", "page_end", "doc_type", "heading_path")]
    rows = rows.withColumn("whole", retrieve.context_block(*args, parent, F.col("content"))).withColumn("small", retrieve.context_block(*args, F.lit(None).cast("string"), F.col("content")))
    sized = rows.withColumn("f", T.token_estimate(F.col("whole"))).withColumn("c", T.token_estimate(F.col("small")))
    chosen = retrieve.within_budget(sized, "request_id", "ref", "f", "c")
    blocks = sized.join(chosen, ["request_id", "ref"]).withColumn("block", F.when(F.col("form") == "full", F.col("whole")).otherwise(F.col("small")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ref", "block"))), lambda x: x["block"])  # what a budget of tokens has left
    return blocks.groupBy("request_id").agg(F.array_join(parts, "\n\n---\n\n").alias("context"), F.max("used").alias("tokens"))


@query(f"""WITH q AS (SELECT DISTINCT request_id FROM ranked_candidates), t AS (SELECT id, any_value(content) AS content FROM rag_chunks GROUP BY 1), c AS (SELECT DISTINCT request_id, chunk_id FROM ranked_candidates)
SELECT request_id, count(*) AS candidates, count(t.id) AS alive FROM c LEFT JOIN t ON t.id = c.chunk_id GROUP BY 1""")
def candidates_alive(spark, folder):
    rows = load(spark, folder, "ranked_candidates", "request_id", "chunk_id").distinct()
    alive = load(spark, folder, "rag_chunks", "id").distinct()
    return rows.join(alive, rows["chunk_id"] == alive["id"], "left").groupBy("request_id").agg(F.count("*").alias("candidates"), F.count("id").alias("alive"))


@query(f"""SELECT item_id, effective, reason, CASE WHEN marks > 1 THEN marks ELSE 1 END + more AS intents FROM (SELECT item_id, q AS effective,
  CASE WHEN q = '' OR NOT regexp_matches(q, '[\\p{{L}}\\p{{N}}_]') THEN 'empty_query' WHEN length(q) < 2 THEN 'query_too_short' END AS reason,
  len(regexp_extract_all(q, '[?？]'))::INT AS marks, (len(regexp_extract_all(q, '以及|同时|并且|还有| and | plus |；|;')) + CASE WHEN length(q) > 8 THEN len(regexp_extract_all(q, '和')) ELSE 0 END)::INT AS more
  FROM (SELECT item_id, {_QUESTION} AS q FROM eval_items))""")
def query_analysis(spark, folder):
    rows = load(spark, folder, "eval_items", "item_id", "question")
    a = T.analyze_query(F.col("question"))
    return rows.select("item_id", a["effective"].alias("effective"), a["reason"].alias("reason"), a["intents"].alias("intents"))


@query(r"""WITH a AS (SELECT block_id, any_value(text) AS text FROM blocks GROUP BY 1), c AS (SELECT block_id, list_transform(regexp_extract_all(text, '\[(\d{1,9})\]', 1), lambda x: x::INT) AS c FROM a WHERE regexp_matches(text, '\[\d{1,9}\]'))
SELECT block_id, list_min(list_filter(c, lambda x: x NOT IN (1, 2, 3))) IS NULL AS valid, 'invented citation: ' || list_min(list_filter(c, lambda x: x NOT IN (1, 2, 3))) AS reason FROM c""")
def citation_check(spark, folder):
    rows = load(spark, folder, "blocks", "block_id", "text").where(F.col("text").rlike(r"\[\d{1,9}\]")).distinct()
    ok = T.check_citations(F.col("text"), F.array(F.lit(1), F.lit(2), F.lit(3)))
    return rows.select("block_id", ok["valid"].alias("valid"), ok["reason"].alias("reason"))


@query()
def retrieve_batch(spark, folder):
    """Every held-out question through the whole chain, with the built-in embedder."""
    from quern.operators.embed import embed
    from quern.operators.pipeline import answer_contexts

    asked = load(spark, folder, "eval_items", "item_id", "question").withColumnRenamed("item_id", "request_id")
    requests = asked.join(embed(asked, "request_id", "question").select("request_id", F.col("embedding").alias("vector")), "request_id")
    chunks = load(spark, folder, "rag_chunks", "id", "document_id", "parent_key", "content", "tenant_id", "department", "access_level", "status", "source_uri", "doc_type", "page_start", "page_end", "heading_path")
    vectors = embed(chunks.select("id", "content").distinct(), "id", "content").select(F.col("id").alias("chunk_id"), "embedding")
    parents = _parents(spark, folder)
    titles = load(spark, folder, "rag_documents", "id", "title").groupBy(F.col("id").alias("document_id")).agg(F.max("title").alias("title"))
    out = answer_contexts(requests, chunks, vectors, parents, titles, filters.visible(TENANT, DEPARTMENT, LEVEL), top_k=20)
    return out.select("request_id", "status", "reason", "confidence", "context", "tokens", F.size("references").alias("references"), F.size("hits").alias("hits"))
