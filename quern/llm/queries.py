"""Queries pN_... over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import load


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    from .neardup import near_duplicates
    from .spans import expand_pairs

    pairs, members = near_duplicates(load(spark, folder, "rag_chunks", "id", "content"), "id", "content")
    found = pairs.select(F.col("rep_a").alias("id_a"), F.col("rep_b").alias("id_b"))
    return expand_pairs(found, members).distinct()


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs between the representatives of equal texts; with p1_members the same as p1_found, without its copies."""
    from .neardup import near_duplicates

    return near_duplicates(load(spark, folder, "rag_chunks", "id", "content"), "id", "content")[0].select("rep_a", "rep_b", F.round("similarity", 6).alias("similarity"))


def p1_members(spark: SparkSession, folder: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(load(spark, folder, "rag_chunks", "id", "content"), "id", "content")[1].select("id", "rep")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    from .vectors import similar_vectors

    table = load(spark, folder, "vector_chunks", "chunk_id", "embedding", "embedding_model", "embedding_dim")
    near = similar_vectors(table, "chunk_id", "embedding", ["embedding_model"], "embedding_dim", k=10, floor=0.9, recall=1.0)
    return near.select(F.least("id", "other").alias("chunk_id_a"), F.greatest("id", "other").alias("chunk_id_b")).distinct()


def p2_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 most similar vectors, however similar, of every row whose id is divisible by 20."""
    from .vectors import similar_vectors

    table = load(spark, folder, "vector_chunks", "chunk_id", "embedding", "embedding_model", "embedding_dim")
    near = similar_vectors(table, "chunk_id", "embedding", ["embedding_model"], "embedding_dim", k=10, asking=F.col("chunk_id") % 20 == 0)
    return near.select(F.col("id").alias("chunk_id"), F.col("other").alias("other_id"), "place")


def _ranked(spark: SparkSession, folder: str, ranker: Callable[..., DataFrame]) -> DataFrame:
    table = load(spark, folder, "ranked_candidates", "request_id", "chunk_id", "rerank_score", "vector_score", "final_top_k")
    return ranker(table, "request_id", "chunk_id", ["rerank_score", "vector_score"], {"final_top_k": F.max("final_top_k")})


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The first by the sum of two places; the walk has another order (p3_walk) and no part in this one."""
    from .fuse import first_of_group, item_places

    order = [F.col("place_rerank_score") + F.col("place_vector_score"), F.col("place_rerank_score"), F.col("chunk_id")]
    return first_of_group(_ranked(spark, folder, item_places), "request_id", "chunk_id", order, "final_top_k").select("request_id", "chunk_id")


def p3_walk(spark: SparkSession, folder: str) -> DataFrame:
    from .fuse import first_of_group, rank_walk

    # shares that differ by less than the walk's own accuracy are ties; the logarithm makes that relative to their size
    order = [F.desc(F.round(F.ln("stationarity"), 8)), F.asc("place_rerank_score"), F.asc("chunk_id")]
    return first_of_group(_ranked(spark, folder, rank_walk), "request_id", "chunk_id", order, "final_top_k").select("request_id", "chunk_id", "stationarity")


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    from .markup import markup_residue

    return markup_residue(load(spark, folder, "blocks", "block_id", "block_type", "text", "html", "markdown"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _marked(spark, folder).select("block_id").distinct()


def p4_text(spark: SparkSession, folder: str) -> DataFrame:
    return _marked(spark, folder).select("block_id", "marks", "clean").distinct()


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    from .pack import oversized_pieces

    return oversized_pieces(
        load(spark, folder, "blocks", "block_id", "document_id", "text"),
        load(spark, folder, "parent_chunks", "parent_id", "document_id", "text"),
        load(spark, folder, "rag_documents", "package_id", "doc_type"),
        load(spark, folder, "chunker_configs", "template", "child_max_tokens", "overlap_tokens"),
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).where("piece = 1").select("item_kind", "item_id").distinct()


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder)


def _scanned(spark: SparkSession, folder: str) -> DataFrame:
    from .scans import scanned_faults

    return scanned_faults(load(spark, folder, "blocks", "document_id", "block_id", "page_number", "reading_order", "block_type", "text", "bbox"), load(spark, folder, "rag_documents", "package_id", "source_uri"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scanned(spark, folder).select("block_id").distinct()


def p6_text(spark: SparkSession, folder: str) -> DataFrame:
    return _scanned(spark, folder).select("block_id", "kinds", "clean")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    from .tokenize import encode_texts

    return encode_texts(load(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    from .leak import leaked

    docs, items = load(spark, folder, "documents", "doc_id", "text"), load(spark, folder, "eval_items", "item_id", "passage")
    return leaked(docs, "doc_id", "text", items, "item_id", "passage").select("doc_id", "item_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    from .spans import expand_pairs, shared_spans

    docs = load(spark, folder, "documents", "doc_id", "text")
    spans, members = shared_spans(docs, "doc_id", "text", unique=True)
    pairs = expand_pairs(spans.select("id_a", "id_b").distinct(), members)
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p9_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Maximal shared stretches between the representatives of equal texts."""
    from .spans import shared_spans

    return shared_spans(load(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", unique=True)[0]


def p9_members(spark: SparkSession, folder: str) -> DataFrame:
    from .spans import shared_spans

    return shared_spans(load(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", unique=True)[1].select(F.col("id").alias("doc_id"), "rep")


def p9_shared(spark: SparkSession, folder: str) -> DataFrame:
    from .spans import shared_share, shared_spans

    docs = load(spark, folder, "documents", "doc_id", "text")
    spans, members = shared_spans(docs, "doc_id", "text", unique=True)
    return shared_share(spans, members).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pairs, p1_members, p2_found, p2_nearest, p3_found, p3_walk, p4_found, p4_text, p5_found, p5_pieces, p6_found, p6_text, p7_ids, p8_found, p9_found, p9_spans, p9_members, p9_shared)}


_P1 = r"""
WITH c AS (SELECT DISTINCT id, content FROM rag_chunks WHERE content IS NOT NULL),
t AS (SELECT id, content, regexp_extract_all(regexp_replace(lower(content), '([\x{4e00}-\x{9fff}])', ' \1 ', 'g'), '[\p{L}\p{N}]+') AS t FROM c),
d AS (SELECT min(id) AS rep, content, any_value(t) AS t FROM t WHERE len(t) >= 20 GROUP BY content),
g AS (SELECT rep, len(t) - 1 AS n, t[i::BIGINT] || ' ' || t[i::BIGINT + 1] AS p FROM d, unnest(range(1, len(t))) AS u(i)),
k AS (SELECT rep, n, p, count(*) AS k FROM g GROUP BY ALL),
s AS (SELECT a.rep AS x, b.rep AS y FROM k a JOIN k b ON a.p = b.p AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING sum(least(a.k, b.k)) >= 0.7 * greatest(a.n, b.n)),
m AS (SELECT t.id, d.rep FROM t JOIN d USING (content))
SELECT DISTINCT least(p.id, q.id) AS id_a, greatest(p.id, q.id) AS id_b FROM (SELECT x, y FROM s UNION ALL SELECT rep, rep FROM d) s JOIN m p ON p.rep = s.x JOIN m q ON q.rep = s.y WHERE p.id <> q.id"""

_P1_PAIRS = _P1[: _P1.index("m AS (")].rstrip().rstrip(",").replace("SELECT a.rep AS x, b.rep AS y FROM", "SELECT a.rep AS rep_a, b.rep AS rep_b, round(sum(least(a.k, b.k)) / greatest(a.n, b.n), 6) AS similarity FROM") + " SELECT * FROM s"
_P1_MEMBERS = _P1[: _P1.index("g AS (")].rstrip().rstrip(",") + " SELECT DISTINCT t.id, d.rep FROM t JOIN d USING (content)"

_P2 = """
WITH u AS (SELECT chunk_id, embedding_model AS m, embedding_dim AS d, min(embedding)::DOUBLE[] AS e FROM vector_chunks
  WHERE embedding IS NOT NULL AND len(embedding) = embedding_dim AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) GROUP BY ALL),
n AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.e, b.e) AS c FROM u a JOIN u b ON a.m = b.m AND a.d = b.d AND a.chunk_id <> b.chunk_id),
r AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM n)
SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM r WHERE k <= 10 AND c >= 0.9"""

_P3 = """
WITH c AS (SELECT request_id, chunk_id, max(CASE WHEN NOT isnan(rerank_score) THEN rerank_score END) AS r,
    max(CASE WHEN NOT isnan(vector_score) THEN vector_score END) AS v, max(final_top_k) AS k FROM ranked_candidates GROUP BY ALL),
p AS (SELECT *, rank() OVER (PARTITION BY request_id ORDER BY r DESC NULLS LAST) AS pr, rank() OVER (PARTITION BY request_id ORDER BY v DESC NULLS LAST) AS pv FROM c)
SELECT request_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY pr + pv, pr, chunk_id) AS n FROM p) WHERE n <= k"""

_P5 = r"""
WITH i AS (SELECT 'block' AS item_kind, block_id AS item_id, document_id, text FROM blocks UNION ALL SELECT 'parent', parent_id, document_id, text FROM parent_chunks),
e AS (SELECT *, len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}\x{20000}-\x{2a6df}]'))
    + floor(1.3::DOUBLE * len(regexp_extract_all(text, '[a-zA-Z0-9]+(?:[-''][a-zA-Z0-9]+)*'))) AS n FROM i)
SELECT DISTINCT item_kind, item_id FROM e LEFT JOIN rag_documents d ON d.package_id = e.document_id LEFT JOIN chunker_configs c ON c.template = d.doc_type
WHERE n > coalesce(c.child_max_tokens, (SELECT child_max_tokens FROM chunker_configs WHERE template = 'generic_structured'))"""

_P8 = r"""
WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_replace(lower(passage), '[^\p{L}\p{N}]', '', 'g') AS t FROM eval_items),
dw AS (SELECT doc_id, substr(t, k::BIGINT, 60) AS w FROM d, unnest(range(1, length(t) - 58)) AS u(k)),
iw AS (SELECT item_id, substr(t, k::BIGINT, 60) AS w FROM i, unnest(range(1, length(t) - 58)) AS u(k))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (w)"""

_P9 = """
WITH g AS (SELECT DISTINCT doc_id, md5(substr(text, k::BIGINT, 200)) AS w FROM documents, unnest(range(1, length(text) - 198)) AS u(k) WHERE text IS NOT NULL),
s AS (SELECT w FROM g GROUP BY w HAVING count(*) > 1), h AS (SELECT g.* FROM g JOIN s USING (w))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM h a JOIN h b ON a.w = b.w AND a.doc_id < b.doc_id"""


_P9_MEMBERS = """
WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 200) SELECT DISTINCT doc_id, min(doc_id) OVER (PARTITION BY text) AS rep FROM d"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _P1, "p1_pairs": _P1_PAIRS, "p1_members": _P1_MEMBERS, "p2_found": _P2, "p3_found": _P3, "p5_found": _P5, "p8_found": _P8, "p9_found": _P9, "p9_members": _P9_MEMBERS}
