"""Queries of text, blocks and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import layout as L
from quern.functions import text as T
from quern.operators import blocks as B
from quern.operators import chunkers, postprocess, stats, store, validate
from quern.sources import files, load

from .registry import query

_WS = T.WS
_IN = T.WS_INLINE
_NORM = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\x{{feff}}', '', 'g'), '\r\n|\r', chr(10), 'g'), '{_IN}+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_WS}+|{_WS}+$', '', 'g')"
_EST = r"(len(regexp_extract_all(coalesce(text, ''), '[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}\x{20000}-\x{2a6df}]')) + floor(1.3::DOUBLE * len(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9]+(?:[-''][a-zA-Z0-9]+)*'))))::INT"
_SQUASH = rf"trim(regexp_replace(text, '{_WS}+', ' ', 'g'))"
_STRIP = rf"regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g')"
_BLOCKS = "(SELECT block_id, document_id, any_value(page_number) AS page_number, any_value(block_type) AS block_type, any_value(text) AS text, any_value(bbox) AS bbox, any_value(reading_order) AS reading_order, any_value(section_id) AS section_id, any_value(html) AS html FROM blocks GROUP BY 1, 2)"
_EDGE = "coalesce((bbox.y0 + bbox.y1) / 2 <= 90 OR (bbox.y0 + bbox.y1) / 2 >= 700, false)"
_POLICY = B.POLICY_HEADER.replace("\\d", "0-9").replace("\\S", "[^ \\t\\n\\r]").replace("\\s", "[ \\t\\n\\r]")


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    names = ("block_id", "document_id", "page_number", "block_type", "text", "bbox", "reading_order", "heading_path", "section_id", "metadata")
    return B.deliver_once(load(spark, folder, "blocks", *names))


@query(f"SELECT doc_id, {_EST} AS tokens FROM documents")
def token_estimate(spark, folder):
    return load(spark, folder, "documents", "doc_id", "text").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, len(list_filter(string_split_regex(text, '{_WS}+'), lambda w: w <> ''))::INT AS words FROM documents WHERE text IS NOT NULL")
def word_count(spark, folder):
    return load(spark, folder, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.size(T.words(F.col("text"))).alias("words"))


@query(f"SELECT doc_id, sha256({_NORM}) AS hash FROM documents WHERE text IS NOT NULL")
def content_hash(spark, folder):
    return load(spark, folder, "documents", "doc_id", "text").where("text is not null").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query(f"SELECT hash, count(*) AS copies, min(doc_id) AS first FROM (SELECT doc_id, sha256({_NORM}) AS hash FROM documents WHERE text IS NOT NULL) GROUP BY 1 HAVING count(*) > 1")
def dedupe_by_hash(spark, folder):
    rows = load(spark, folder, "documents", "doc_id", "text").where("text is not null").select("doc_id", T.content_hash(F.col("text")).alias("hash"))
    return rows.groupBy("hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


@query("""SELECT DISTINCT block_id, substr(sha256(concat_ws(':', 'block', document_id, page_number::VARCHAR, reading_order::VARCHAR, block_type)), 1, 32) AS own_id,
  substr(sha256('section:' || document_id || ':' || CASE WHEN len(heading_path) > 0 THEN array_to_string(heading_path, ' > ') ELSE 'Document' END), 1, 32) AS own_section FROM blocks""")
def stable_ids(spark, folder):
    rows = load(spark, folder, "blocks", "block_id", "document_id", "page_number", "reading_order", "block_type", "heading_path")
    return rows.select(
        "block_id",
        T.block_id(F.col("document_id"), F.col("page_number"), F.col("reading_order"), F.col("block_type")).alias("own_id"),
        T.section_id(F.col("document_id"), F.coalesce("heading_path", F.array().cast("array<string>"))).alias("own_section"),
    ).distinct()


@query(r"SELECT DISTINCT embedding_model, lower(regexp_replace(embedding_model, '[^a-zA-Z0-9]+', '_', 'g')) AS slug FROM vector_chunks")
def model_slugs(spark, folder):
    return load(spark, folder, "vector_chunks", "embedding_model").distinct().select("embedding_model", T.model_slug(F.col("embedding_model")).alias("slug"))


@query(f"""SELECT block_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'),
  '{_WS}+', ' ', 'g')) AS plain FROM {_BLOCKS} WHERE html IS NOT NULL""")
def html_strip(spark, folder):
    return load(spark, folder, "blocks", "block_id", "html").where("html is not null").distinct().select("block_id", T.strip_tags(F.col("html")).alias("plain"))


@query()
def html_tables(spark, folder):
    return files.html_tables(load(spark, folder, "blocks", "block_id", "html").distinct(), "block_id", "html").select("block_id", F.size("rows").alias("rows"), "markdown")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE props IS NOT NULL""")
def audit_redact(spark, folder):
    rows = load(spark, folder, "events", "event_id", "props").where("props is not null")
    return rows.select("event_id", F.try_element_at(T.redact(F.from_json("props", "map<string,string>")), F.lit("k")).alias("k"))


_PARTS = rf"""t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\x{{feff}}', ''), '\r\n|\r', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, list_filter(list_transform(string_split_regex(t, '\n{_WS}*\n'), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '') AS p,
  list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '') AS l FROM t),
b AS (SELECT doc_id, CASE WHEN len(p) > 1 THEN p ELSE l END AS q FROM a),
parts AS (SELECT doc_id, (i - 1)::INT AS reading_order, q[i] AS text FROM b, unnest(range(1, len(q) + 1)) AS u(i))"""


@query(rf"""WITH {_PARTS}, k AS (SELECT *, regexp_full_match(text, '#{{1,6}}[ \t]+[^\n]+') AS md, split_part(text, chr(10), 1) AS line FROM parts),
m AS (SELECT *, md OR (length(line) <= 80 AND (lower(trim(line)) IN ('abstract', 'references', 'contents', 'faq') OR regexp_matches(lower(line), '^(?:chapter|section|part|appendix) '))) AS head FROM k),
n AS (SELECT doc_id, reading_order, CASE WHEN head THEN 'heading' WHEN regexp_matches(text, '^(?:[-*+][ \t\n\r\f\v]+|[0-9]+[.)][ \t\n\r\f\v]+|[①②③④⑤⑥⑦⑧⑨⑩])') THEN 'list_item' ELSE 'paragraph' END AS block_type,
  CASE WHEN md THEN regexp_replace(regexp_extract(text, '^#{{1,6}}[ \t]+([^\n]+)$', 1), '^{_WS}+|{_WS}+$', '', 'g') ELSE text END AS text FROM m)
SELECT doc_id, reading_order, block_type, text, last_value(CASE WHEN block_type = 'heading' THEN regexp_replace(split_part(text, chr(10), 1), '^{_WS}+|{_WS}+$', '', 'g') END IGNORE NULLS)
  OVER (PARTITION BY doc_id ORDER BY reading_order ROWS UNBOUNDED PRECEDING) AS heading FROM n""")
def text_blocks(spark, folder):
    return B.text_blocks(load(spark, folder, "documents", "doc_id", "text"), "doc_id", "text").drop("block_id")


_REP = f"""rep AS (SELECT document_id, lower({_SQUASH}) AS shape, count(DISTINCT page_number)::INT AS pages FROM b WHERE {_SQUASH} <> '' AND length({_SQUASH}) <= 120
  AND ({_EDGE} OR regexp_matches(lower({_SQUASH}), 'confidential|draft|copyright|版权所有|保密|内部资料')
    OR (page_number > 1 AND length({_STRIP}) <= 120 AND NOT regexp_matches({_STRIP}, '^第[零一二三四五六七八九十百千万0-9]+[条款章节]') AND regexp_matches({_STRIP}, '{_POLICY}') AND (bbox IS NULL OR {_EDGE})))
  GROUP BY 1, 2 HAVING count(DISTINCT page_number) >= 2)"""


@query(f"WITH b AS {_BLOCKS}, {_REP} SELECT * FROM rep")
def repeated_lines(spark, folder):
    return B.repeated_edge_texts(_blocks(spark, folder))


@query(f"""WITH b AS {_BLOCKS}, {_REP}, m AS (SELECT b.*, {_STRIP} AS s, rep.shape IS NOT NULL AS again FROM b LEFT JOIN rep ON rep.document_id = b.document_id AND rep.shape = lower({_SQUASH}))
SELECT block_id, CASE WHEN s = '' THEN 'empty' WHEN block_type IN ('header', 'footer', 'page_number') THEN 'type'
  WHEN length(s) <= 20 AND regexp_matches(s, '(?i)^(?:(?:第[ \\t]*)?[0-9]{{1,4}}[ \\t]*(?:页)?|page[ \\t]+[0-9]{{1,4}}|[—–-][ \\t]*[0-9]{{1,4}}[ \\t]*[—–-])$') THEN 'page_number'
  WHEN length(s) <= 160 AND regexp_matches(s, '^[^\\n]*\\.{{4,}}[ \\t]*[0-9]{{1,4}}$') THEN 'toc_dot_leader'
  WHEN page_number > 1 AND length(s) <= 120 AND NOT regexp_matches(s, '^第[零一二三四五六七八九十百千万0-9]+[条款章节]') AND regexp_matches(s, '{_POLICY}') AND (bbox IS NULL OR {_EDGE}) THEN 'running_header_pattern'
  WHEN again THEN 'repeated_page_edge' END AS noise FROM m""")
def layout_noise(spark, folder):
    return B.layout_noise(_blocks(spark, folder)).select("block_id", "noise")


_SHAPE = rf"lower(regexp_replace(trim(regexp_replace(line, '{_WS}+', ' ', 'g')), '[0-9]+', '#', 'g'))"


@query(rf"""WITH b AS {_BLOCKS}, l AS (SELECT document_id, page_number, reading_order, block_id, i AS n, {_SHAPE} AS shape
  FROM (SELECT document_id, page_number, reading_order, block_id, i, p[i::BIGINT] AS line FROM (SELECT *, string_split_regex(text, '\r\n|\n|\r') AS p FROM b WHERE length(text) > 0), unnest(range(1, len(p) + 1)) AS u(i))),
k AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY reading_order, block_id, n) AS a, row_number() OVER (PARTITION BY document_id, page_number ORDER BY reading_order DESC, block_id DESC, n DESC) AS z FROM l WHERE shape <> ''),
t AS (SELECT document_id, count(DISTINCT page_number) AS total FROM b GROUP BY 1 HAVING count(DISTINCT page_number) >= 3)
SELECT document_id, shape, count(DISTINCT page_number)::INT AS pages FROM k JOIN t USING (document_id) WHERE a <= 3 OR z <= 3 GROUP BY document_id, shape, total HAVING count(DISTINCT page_number) >= greatest(floor(total * 0.5), 1)""")
def header_footer_lines(spark, folder):
    return B.header_footer_lines(_blocks(spark, folder))


_TYPES = " ".join(
    f"WHEN {' + '.join(f'contains(s, $${w}$$)::INT' for w in needles)} > 0 THEN {{{i}}}" for i, (_, needles) in enumerate(B.TYPE_WORDS)
)
_KIND = _TYPES.format(*(f"'{n}'" for n, _ in B.TYPE_WORDS))
_SURE = _TYPES.format(*(f"least(0.9, 0.55 + 0.1 * ({' + '.join(f'contains(s, $${w}$$)::INT' for w in needles)}))" for _, needles in B.TYPE_WORDS))


@query(f"""WITH b AS {_BLOCKS}, o AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY document_id ORDER BY page_number, reading_order, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
g AS (SELECT document_id, avg((block_type = 'table')::INT) AS tables, avg((block_type = 'figure')::INT) AS figures, coalesce(string_agg(lower(text), chr(10) ORDER BY page_number, reading_order, block_id) FILTER (WHERE before < 12000 AND text <> ''), '') AS s FROM o GROUP BY 1)
SELECT document_id, CASE WHEN tables > 0.35 THEN 'table_data' WHEN figures > 0.35 THEN 'picture_pdf' {_KIND} ELSE 'generic_structured' END AS detected,
  round((CASE WHEN tables > 0.35 THEN least(0.95, tables) WHEN figures > 0.35 THEN least(0.95, figures) {_SURE} ELSE 0.3 END)::DOUBLE, 4) AS confidence FROM g""")
def document_type(spark, folder):
    return B.document_types(_blocks(spark, folder))


_NUM = "[零一二三四五六七八九十百千万0-9][ \\t]*"
_STRUCTURED = rf"(?i)^[ \t]*(?:[0-9]+(?:\.[0-9]+){{0,4}}[ \t]+[^ \t]+|chapter[ \t]+[0-9]+\b|section[ \t]+[0-9]+\b|part[ \t]+[0-9]+\b|appendix\b|第[ \t]*(?:{_NUM})+[章节目篇卷])"


@query(rf"""WITH b AS {_BLOCKS}, l AS (SELECT *, regexp_replace(regexp_extract(coalesce(text, ''), '^{_WS}*([^\n\r]*)', 1), '^{_WS}+|{_WS}+$', '', 'g') AS line FROM b),
f AS (SELECT *, regexp_matches(line, '[。！？…；.!?]$') AS ends, regexp_matches(line, '{_STRUCTURED}') AS structured, regexp_matches(line, '^第[ \t]*(?:{_NUM})+[条款章节]{{1,2}}(?:[ \t]|$)') AND length(line) <= 40 AS legal,
  line = '' OR regexp_matches(line, '^[，、；：…—]') OR regexp_matches(line, '^[0-9]{{4}}[ \t]*[年/.-][ \t]*[0-9]{{1,2}}') OR length(line) > 80 AS barred FROM l),
h AS (SELECT *, NOT barred AND ((block_type IN ('heading', 'title') AND (structured OR (NOT ends AND length(line) <= 30))) OR (block_type IN ('paragraph', 'text') AND NOT ends AND (legal OR structured))) AS head FROM f),
c AS (SELECT block_id, last_value(CASE WHEN head THEN line END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page_number, reading_order, block_id ROWS UNBOUNDED PRECEDING) AS t FROM h),
n AS (SELECT *, regexp_extract(t, '^[ \t]*([0-9]+(?:\.[0-9]+){{0,5}})[ \t]+[^ \t]+', 1) AS number, regexp_extract(t, '^[ \t]*第[ \t]*(?:{_NUM})+([章节目篇卷条款])', 1) AS mark FROM c)
SELECT block_id, t AS section_title, coalesce(CASE WHEN t IS NULL THEN NULL WHEN number <> '' THEN least(6, length(number) - length(replace(number, '.', '')) + 1) WHEN mark IN ('章', '篇', '卷') THEN 1 WHEN mark IN ('节', '目', '条') THEN 2 WHEN mark <> '' THEN 3
  WHEN regexp_matches(lower(t), '^(?:chapter |part |appendix)') THEN 1 WHEN starts_with(lower(t), 'section ') THEN 2 ELSE 1 END, 0)::INT AS section_level FROM n""")
def heading_carry(spark, folder):
    return B.heading_carry(_blocks(spark, folder)).select("block_id", "section_title", F.coalesce("section_level", F.lit(0)).alias("section_level"))


_RUNS = f"""b AS {_BLOCKS}, o AS (SELECT *, CASE WHEN section_id IS DISTINCT FROM lag(section_id) OVER w AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS turn, {_STRIP} AS t FROM b WINDOW w AS (PARTITION BY document_id ORDER BY page_number, reading_order, block_id)),
r AS (SELECT *, sum(turn) OVER (PARTITION BY document_id ORDER BY page_number, reading_order, block_id ROWS UNBOUNDED PRECEDING) AS run FROM o),
k AS (SELECT *, (page_number, reading_order, block_id) AS pos FROM r), c AS (SELECT * FROM k WHERE block_type NOT IN ('header', 'footer', 'page_number', 'table', 'figure') AND t <> ''),
m AS (SELECT * FROM k WHERE block_type IN ('table', 'figure', 'caption')),
x AS (SELECT m.document_id, m.block_id, c.t, c.pos, row_number() OVER (PARTITION BY m.document_id, m.block_id ORDER BY c.pos DESC) AS n FROM m JOIN c ON m.document_id = c.document_id AND m.run = c.run AND c.pos < m.pos),
y AS (SELECT m.document_id, m.block_id, c.t, c.pos, row_number() OVER (PARTITION BY m.document_id, m.block_id ORDER BY c.pos) AS n FROM m JOIN c ON m.document_id = c.document_id AND m.run = c.run AND c.pos > m.pos)"""


@query(f"""WITH {_RUNS} SELECT document_id, block_id, coalesce((SELECT string_agg(t, chr(10) || chr(10) ORDER BY pos) FROM x WHERE x.document_id = m.document_id AND x.block_id = m.block_id AND n <= 2), '') AS before,
  coalesce((SELECT string_agg(t, chr(10) || chr(10) ORDER BY pos) FROM y WHERE y.document_id = m.document_id AND y.block_id = m.block_id AND n <= 2), '') AS after FROM m""")
def neighbour_context(spark, folder):
    return B.neighbour_context(_blocks(spark, folder))


@query(f"""WITH b AS {_BLOCKS} SELECT document_id, page_number, block_id FROM (SELECT *, lag(page_number) OVER (PARTITION BY document_id ORDER BY reading_order, block_id) AS p FROM b) WHERE p > page_number""")
def order_violations(spark, folder):
    return B.order_violations(_blocks(spark, folder))


@query(f"""WITH b AS {_BLOCKS} SELECT document_id, page_number, count(*)::INT AS n, sum(len(list_filter(string_split_regex(text, '{_WS}+'), lambda w: w <> '')))::BIGINT AS words FROM b
  WHERE block_type NOT IN ('header', 'footer', 'page_number') AND {_STRIP} <> '' GROUP BY 1, 2""")
def page_groups(spark, folder):
    return B.page_texts(_blocks(spark, folder))


@query(f"""WITH b AS {_BLOCKS}, r AS (SELECT *, {_STRIP} AS t FROM b), q AS (SELECT *, (page_number, reading_order, block_id) AS pos, block_type = 'heading' AS ask FROM r WHERE t <> ''),
n AS (SELECT *, sum(ask::INT) OVER (PARTITION BY document_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::INT AS pair FROM q)
SELECT document_id, pair, max(CASE WHEN ask THEN regexp_extract(t, '^[^\\n\\r]*', 0) END) AS question, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE NOT ask), '') AS answer
FROM n WHERE pair > 0 AND (ask OR block_type <> 'heading') GROUP BY 1, 2""")
def question_pairs(spark, folder):
    """Headings as questions, marked as such, and what follows them as answers."""
    rows = _blocks(spark, folder)
    asks = (F.col("block_type") == "heading") & (T.strip(F.coalesce("text", F.lit(""))) != "")
    return B.question_pairs(rows.withColumn("text", F.when(asks, F.concat(F.lit("Q: "), T.strip(F.col("text")))).otherwise(F.col("text"))))


@query(f"SELECT block_id, block_type, {_EST} AS tokens FROM {_BLOCKS} WHERE block_type IN ('table', 'code', 'formula')")
def media_tokens(spark, folder):
    return _blocks(spark, folder).where(F.col("block_type").isin("table", "code", "formula")).select("block_id", "block_type", T.token_estimate(F.col("text")).alias("tokens"))


def _drafts(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "rag_documents", "package_id", "doc_type").select(F.col("package_id").alias("document_id"), F.col("doc_type").alias("template"))
    return chunkers.chunk_blocks(load(spark, folder, "blocks"), docs, load(spark, folder, "chunker_configs"))


@query()
def chunk_documents(spark, folder):
    return _drafts(spark, folder).withColumn("block_ids", F.array_join("block_ids", ","))


@query()
def greedy_pack(spark, folder):
    """Chunks and tokens of each document under the plain template."""
    docs = load(spark, folder, "rag_documents", "package_id").select(F.col("package_id").alias("document_id"), F.lit("generic_structured").alias("template"))
    drafts = chunkers.chunk_blocks(_blocks(spark, folder), docs, load(spark, folder, "chunker_configs"))
    return drafts.groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum("token_count").cast("bigint").alias("tokens"), F.max("token_count").alias("largest"))


@query()
def chunk_parents(spark, folder):
    return chunkers.parents_of(_drafts(spark, folder))


@query()
def finished_chunks(spark, folder):
    return postprocess.finish_chunks(_drafts(spark, folder), load(spark, folder, "chunker_configs"))


@query()
def chunk_quality(spark, folder):
    return stats.quality(postprocess.finish_chunks(_drafts(spark, folder), load(spark, folder, "chunker_configs")))


@query(f"""WITH b AS (SELECT document_id, page_number, CASE WHEN len(p) > 0 THEN p ELSE ['Document'] END AS p FROM (SELECT document_id, page_number,
  list_filter(list_transform(coalesce(heading_path, []::VARCHAR[]), lambda x: trim(x)), lambda x: x <> '') AS p FROM {_BLOCKS} JOIN (SELECT DISTINCT block_id, document_id, heading_path FROM blocks) USING (block_id, document_id))),
s AS (SELECT document_id, page_number, p[1:n::BIGINT] AS p FROM b, unnest(range(1, len(p) + 1)) AS u(n))
SELECT document_id, substr(sha256('section:' || document_id || ':' || array_to_string(p, ' > ')), 1, 32) AS section_id,
  CASE WHEN len(p) > 1 THEN substr(sha256('section:' || document_id || ':' || array_to_string(p[1:-2], ' > ')), 1, 32) END AS parent_section_id, p[-1] AS title, len(p)::INT AS level, min(page_number) AS page_start, max(page_number) AS page_end
FROM s GROUP BY document_id, p""")
def section_tree(spark, folder):
    return validate.section_tree(_blocks(spark, folder))


@query("""SELECT 'duplicate_block' AS rule, block_id AS key FROM blocks GROUP BY document_id, block_id HAVING count(*) > 1
UNION ALL SELECT 'page_number', block_id FROM blocks WHERE coalesce(page_number <= 0, true) UNION ALL SELECT 'empty_box', block_id FROM blocks WHERE bbox.x0 = bbox.x1 OR bbox.y0 = bbox.y1""")
def document_faults(spark, folder):
    return validate.document_faults(load(spark, folder, "blocks", "document_id", "block_id", "page_number", "bbox"))


@query("""WITH v AS (SELECT chunk_id::VARCHAR AS key, embedding AS e, embedding_model AS m, embedding_dim AS d, CASE embedding_model WHEN 'text-embed-64' THEN 64 WHEN 'compact-embed-48' THEN 48 END AS k FROM vector_chunks)
SELECT 'unknown_model' AS rule, key FROM v WHERE k IS NULL UNION ALL SELECT 'stated_dim', key FROM v WHERE d <> k UNION ALL SELECT 'length', key FROM v WHERE e IS NULL OR coalesce(len(e) <> d, true)
UNION ALL SELECT 'not_finite', key FROM v WHERE NOT list_bool_and(list_transform(e, lambda x: isfinite(x)))""")
def vector_faults(spark, folder):
    return validate.vector_faults(load(spark, folder, "vector_chunks", "chunk_id", "embedding", "embedding_model", "embedding_dim"), {"text-embed-64": 64, "compact-embed-48": 48})


_PAGES = f"p AS (SELECT document_id, page_number, string_agg(text, chr(10) ORDER BY reading_order, block_id) AS t FROM {_BLOCKS} WHERE text <> '' GROUP BY 1, 2)"


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    rows = _blocks(spark, folder).where("text <> ''")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "block_id", "text"))), lambda x: x["text"])  # of one page
    return rows.groupBy("document_id", "page_number").agg(F.array_join(texts, "\n").alias("t"))


@query(rf"""WITH {_PAGES}, g AS (SELECT *, CASE WHEN regexp_matches(lag(t) OVER w, '[。！？；.!?;）)」』"]\s*$') THEN 2 ELSE 0 END AS gap FROM p WINDOW w AS (PARTITION BY document_id ORDER BY page_number)),
s AS (SELECT *, (coalesce(sum(length(t) + gap) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + gap)::BIGINT AS start FROM g)
SELECT document_id, page_number, start, start + length(t) AS stop FROM s""")
def page_offsets(spark, folder):
    return validate.page_offsets(_pages(spark, folder), "t")


_HINTS = ", ".join(f"CASE WHEN regexp_matches(lower(t), $${'|'.join(w)}$$) THEN '{n}' END" for n, w in L.DOMAINS)


@query(f"""WITH {_PAGES}, h AS (SELECT document_id, page_number, list_filter([{_HINTS}], lambda x: x IS NOT NULL) AS h FROM p)
SELECT document_id, page_number, CASE WHEN len(h) > 1 AND list_contains(h, 'Troubleshooting') THEN 'Troubleshooting' ELSE h[1] END AS domain FROM h""")
def page_domains(spark, folder):
    return _pages(spark, folder).select("document_id", "page_number", L.domain_hint(F.col("t")).alias("domain"))


@query()
def merged_lines(spark, folder):
    """Paragraphs of the blocks whose lines are wrapped."""
    return _blocks(spark, folder).where(F.col("text").contains("\n")).select("block_id", F.posexplode(L.merge_lines(F.col("text"))).alias("n", "paragraph"))


@query("""WITH b AS (SELECT DISTINCT document_id, block_id, page_number, reading_order, block_type, text, caption FROM blocks), w AS (SELECT *,
  lag(block_type) OVER o AS lt, lag(trim(coalesce(text, ''))) OVER o AS lx, lead(block_type) OVER o AS rt, lead(trim(coalesce(text, ''))) OVER o AS rx FROM b WINDOW o AS (PARTITION BY document_id, page_number ORDER BY reading_order, block_id))
SELECT document_id, block_id, coalesce(concat_ws(chr(10) || chr(10), nullif(trim(caption), ''), CASE WHEN lt = 'caption' THEN lx END, CASE WHEN rt = 'caption' THEN rx END), '') AS caption FROM w WHERE block_type IN ('table', 'figure')""")
def media_captions(spark, folder):
    names = ("document_id", "block_id", "page_number", "reading_order", "block_type", "text", "caption")
    return validate.captions(load(spark, folder, "blocks", *names).dropDuplicates(["document_id", "block_id"]))


@query()
def split_markers(spark, folder):
    return validate.split_markers(_blocks(spark, folder))


@query()
def chunk_faults(spark, folder):
    drafts = _drafts(spark, folder)
    return validate.chunk_faults(drafts, chunkers.parents_of(drafts), _blocks(spark, folder))


@query()
def article_parts(spark, folder):
    laws = _drafts(spark, folder).where("template in ('laws', 'contract_terms')")
    article = F.when(F.regexp_extract("text", r"第[^\s]{1,8}条", 0) != "", F.regexp_extract("text", r"第[^\s]{1,8}条", 0))
    return validate.article_parts(laws.withColumn("article", article), "article").select("document_id", "chunk_id", "article", "part", "parts")


@query()
def clean_pages(spark, folder):
    rows = _blocks(spark, folder)
    return validate.without_running_lines(rows, B.header_footer_lines(rows)).select("block_id", "text")


_HASH = _NORM.replace("(text,", "(t,")


@query(rf"""WITH b AS (SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY page_number, reading_order, block_id) AS t FROM {_BLOCKS} WHERE {_STRIP} <> '' GROUP BY 1),
q AS (SELECT DISTINCT document_id, parent_id, text, page_start FROM parent_chunks WHERE text IS NOT NULL), p AS (SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY page_start, parent_id) AS t FROM q GROUP BY 1),
d AS (SELECT DISTINCT package_id AS document_id FROM rag_documents), a AS (SELECT document_id, coalesce(b.t, p.t) AS t FROM d LEFT JOIN b USING (document_id) LEFT JOIN p USING (document_id))
SELECT document_id, sha256({_HASH}) AS hash FROM a""")
def package_hashes(spark, folder):
    docs = load(spark, folder, "rag_documents", "package_id").withColumnRenamed("package_id", "document_id")
    blocks = load(spark, folder, "blocks", "document_id", "block_id", "page_number", "reading_order", "text")
    return store.package_hashes(docs, blocks, load(spark, folder, "parent_chunks", "document_id", "parent_id", "page_start", "text"))


@query(f"""WITH b AS {_BLOCKS}, d AS (SELECT DISTINCT block_id, heading_path FROM blocks), t AS (SELECT b.block_id, lower(array_to_string(coalesce(d.heading_path, []::VARCHAR[]), ' ') || ' ' || substr(coalesce(b.text, ''), 1, 1200)) AS s FROM b JOIN d USING (block_id))
SELECT block_id, CASE WHEN regexp_matches(s, 'troubleshoot') THEN 'Troubleshooting' WHEN regexp_matches(s, 'removal|installation') THEN 'Engine' WHEN contains(s, 'generator') THEN 'Generator' WHEN regexp_matches(s, 'maintenance|lubrication|filter') THEN 'Maintenance'
  WHEN regexp_matches(s, 'engine|fuel|coolant') THEN 'Engine' WHEN regexp_matches(s, 'electric|circuit|wiring') THEN 'Electrical' WHEN regexp_matches(s, 'repair|torque|adjustment') THEN 'Maintenance' WHEN regexp_matches(s, '责任免除|免责') THEN '责任免除'
  WHEN regexp_matches(s, '保险责任|保险金|给付') THEN '保险责任' WHEN regexp_matches(s, '理赔|赔偿|赔付|申请保险金') THEN '理赔' WHEN regexp_matches(s, '合同成立|合同效力|合同解除|合同终止') THEN '合同条款' WHEN regexp_matches(s, '保险费|缴费|费率') THEN '保险费'
  WHEN regexp_matches(s, '犹豫期|宽限期|等待期') THEN '期间条款' WHEN regexp_matches(s, '被保险人|投保人|受益人') THEN '保险条款' END AS domain FROM t""")
def heading_domains(spark, folder):
    return _blocks(spark, folder).select("block_id", L.heading_domain(F.col("heading_path"), F.col("text")).alias("domain"))


@query("SELECT DISTINCT document_id, block_id, coalesce(heading_path[1], 'Document') AS section FROM blocks")
def top_sections(spark, folder):
    return validate.top_sections(_blocks(spark, folder))


@query("""WITH b AS (SELECT DISTINCT document_id, block_id, page_number, heading_path FROM blocks), f AS (SELECT DISTINCT document_id, heading_path[1:n::BIGINT] AS p FROM b, unnest(range(1, len(heading_path) + 1)) AS u(n) WHERE page_number = 1)
SELECT 'unknown_path' AS rule, block_id AS key FROM b WHERE len(heading_path) > 0 AND NOT EXISTS (SELECT 1 FROM f WHERE f.document_id = b.document_id AND f.p = b.heading_path)""")
def unknown_paths(spark, folder):
    """Blocks whose section is not met on the first page."""
    rows = _blocks(spark, folder)
    return validate.unknown_paths(rows, validate.section_tree(rows.where("page_number = 1")))


@query("SELECT count(*) AS rows FROM blocks WHERE metadata IS NOT NULL AND coalesce(json_type(CASE WHEN json_valid(metadata) THEN metadata END), '') <> 'OBJECT'")
def shapeless_metadata(spark, folder):
    return validate.shapeless_metadata(load(spark, folder, "blocks", "metadata"))


def _media_context(spark: SparkSession, folder: str) -> DataFrame:
    names = ("document_id", "block_id", "page_number", "reading_order", "block_type", "text", "section_id", "caption")
    return B.media_context(_drafts(spark, folder), B.deliver_once(load(spark, folder, "blocks", *names)), load(spark, folder, "chunker_configs"))


@query()
def media_context(spark, folder):
    return _media_context(spark, folder)


@query()
def context_coverage(spark, folder):
    return stats.context_coverage(_media_context(spark, folder)).select(F.round("coverage", 6).alias("coverage"))


@query(f"""SELECT d.tenant_id, d.id AS document_id, p.parent_id AS parent_key, coalesce(p.token_count, {_EST.replace("text", "p.text")}) AS token_count FROM (SELECT DISTINCT document_id, parent_id, text, token_count FROM parent_chunks) p JOIN rag_documents d ON d.package_id = p.document_id""")
def parent_rows(spark, folder):
    rows = store.parent_rows(load(spark, folder, "parent_chunks"), load(spark, folder, "rag_documents", "id", "package_id", "tenant_id", "version", "status"))
    return rows.select("tenant_id", "document_id", "parent_key", "token_count")


@query()
def child_rows(spark, folder):
    """Chunks of the documents as rows to store, under the parents that come with them."""
    docs = load(spark, folder, "rag_documents", "id", "package_id", "tenant_id", "version", "status")
    drafts = _drafts(spark, folder)
    parents = chunkers.parents_of(drafts).withColumn("title", F.col("heading")).withColumn("text", F.lit(None).cast("string")).withColumn("token_count", F.col("token_count").cast("int"))
    return store.child_rows(drafts, store.parent_rows(parents, docs), docs)


@query("""WITH u AS (SELECT chunk_id, embedding_model, created_at, embedding, embedding_dim FROM vector_chunks WHERE embedding IS NOT NULL AND len(embedding) = embedding_dim AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))
  AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) AND embedding_dim = CASE embedding_model WHEN 'text-embed-64' THEN 64 WHEN 'compact-embed-48' THEN 48 END)
SELECT chunk_id, embedding_model, epoch_us(max(created_at)) AS created_us FROM u GROUP BY 1, 2""")
def put_vectors(spark, folder):
    rows = load(spark, folder, "vector_chunks", "chunk_id", "embedding", "embedding_model", "embedding_dim", "created_at")
    state, _ = store.put_vectors(rows.where("false"), rows, {"text-embed-64": 64, "compact-embed-48": 48})
    return state.select("chunk_id", "embedding_model", F.unix_micros("created_at").alias("created_us"))


@query("""WITH c AS (SELECT DISTINCT id, tenant_id, status, department, access_level FROM rag_chunks) SELECT DISTINCT v.chunk_id, v.embedding_model, c.tenant_id, c.department, c.access_level FROM vector_chunks v JOIN c ON c.id = v.chunk_id""")
def vector_records(spark, folder):
    chunks = load(spark, folder, "rag_chunks", "id", "tenant_id", "status", "department", "access_level")
    return store.vector_records(load(spark, folder, "vector_chunks", "chunk_id", "tenant_id", "embedding_model"), chunks).select("chunk_id", "embedding_model", "tenant_id", "department", "access_level").distinct()
