"""Queries of versions, collections and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern import streaming
from quern.operators import stats, store
from quern.sources import load

from .registry import query

_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) AS n FROM rag_chunks) WHERE n = 1)"


def _named(df):
    """Results name the lack of a knowledge base -1."""
    return df.withColumn("knowledge_base_id", F.coalesce("knowledge_base_id", F.lit(-1)))


def _documents(spark, folder):
    return load(spark, folder, "rag_documents")


@query(f"SELECT id, epoch_us(updated_at) AS updated_us, status FROM {_LATEST}")
def latest_delivery(spark, folder):
    return store.keep_latest(load(spark, folder, "rag_chunks", "id", "updated_at", "status"), ["id"], "updated_at").select("id", F.unix_micros("updated_at").alias("updated_us"), "status")


@query("SELECT tenant_id, coalesce(knowledge_base_id, -1) AS knowledge_base_id, source_uri, (coalesce(max(version), 0) + 1)::INT AS next_version FROM rag_documents GROUP BY 1, 2, 3")
def next_version(spark, folder):
    return _named(store.next_versions(_documents(spark, folder)))


@query("SELECT tenant_id, coalesce(knowledge_base_id, -1) AS knowledge_base_id, source_uri, arg_max(id, [version, id]) AS id, max(version) AS version FROM rag_documents WHERE status = 'active' GROUP BY 1, 2, 3")
def latest_by_source(spark, folder):
    return _named(store.latest_of_source(_documents(spark, folder)))


@query("""SELECT d.id, coalesce(k.known_id, -1) AS known_id FROM rag_documents d LEFT JOIN (SELECT tenant_id, knowledge_base_id, source_uri, content_hash, arg_max(id, [version, id]) AS known_id FROM rag_documents WHERE status IN ('active', 'superseded')
  GROUP BY 1, 2, 3, 4) k ON k.tenant_id IS NOT DISTINCT FROM d.tenant_id AND k.knowledge_base_id IS NOT DISTINCT FROM d.knowledge_base_id AND k.source_uri IS NOT DISTINCT FROM d.source_uri AND k.content_hash = d.content_hash""")
def already_stored(spark, folder):
    docs = _documents(spark, folder)
    return store.already_stored(docs.select("id", *store.SOURCE, "content_hash"), docs).select("id", F.coalesce("known_id", F.lit(-1)).alias("known_id"))


_SAME = "k.tenant_id IS NOT DISTINCT FROM i.tenant_id AND k.knowledge_base_id IS NOT DISTINCT FROM i.knowledge_base_id AND k.source_uri IS NOT DISTINCT FROM i.source_uri"


@query(f"""WITH i AS (SELECT tenant_id, knowledge_base_id, source_uri, sha256(content_hash || '#2') AS content_hash, updated_at AS came FROM rag_documents
  UNION ALL SELECT tenant_id, knowledge_base_id, source_uri, content_hash, created_at FROM rag_documents),
n AS (SELECT i.*, row_number() OVER (PARTITION BY tenant_id, knowledge_base_id, source_uri, content_hash ORDER BY came) = 1
  AND NOT EXISTS (SELECT 1 FROM rag_documents k WHERE {_SAME} AND k.content_hash = i.content_hash AND k.status IN ('active', 'superseded')) AS fresh FROM i),
c AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY tenant_id, knowledge_base_id, source_uri ORDER BY came, content_hash ROWS UNBOUNDED PRECEDING) AS nth, sum(fresh::INT) OVER (PARTITION BY tenant_id, knowledge_base_id, source_uri) AS total FROM n)
SELECT i.source_uri, i.content_hash, epoch_us(i.came) AS arrived_us, CASE WHEN NOT fresh THEN 'skipped_duplicate' WHEN nth = total THEN 'active' ELSE 'superseded' END AS outcome,
  (CASE WHEN fresh THEN (SELECT max(version) FROM rag_documents k WHERE {_SAME}) + nth ELSE 0 END)::INT AS version FROM c i""")
def stage_ingest(spark, folder):
    docs = _documents(spark, folder)
    incoming = docs.select(*store.SOURCE, F.sha2(F.concat("content_hash", F.lit("#2")), 256).alias("content_hash"), F.col("updated_at").alias("arrived_at")).unionByName(docs.select(*store.SOURCE, "content_hash", F.col("created_at").alias("arrived_at")))
    return store.stage_ingest(incoming, docs).select("source_uri", "content_hash", F.unix_micros("arrived_at").alias("arrived_us"), "outcome", F.coalesce("version", F.lit(0)).alias("version"))


@query("""SELECT id, CASE WHEN status = 'active' AND EXISTS (SELECT 1 FROM rag_documents s WHERE s.status = 'superseded' AND s.tenant_id = d.tenant_id AND s.source_uri = d.source_uri AND s.knowledge_base_id IS NOT DISTINCT FROM d.knowledge_base_id)
  THEN 'superseded' ELSE status END AS status FROM rag_documents d""")
def supersede(spark, folder):
    docs = _documents(spark, folder)
    return store.supersede(docs, docs.where("status = 'superseded'")).select("id", "status")


@query("""WITH o AS (SELECT * FROM rag_documents WHERE status = 'superseded' QUALIFY row_number() OVER (PARTITION BY tenant_id, knowledge_base_id, source_uri ORDER BY version DESC, id DESC) = 1),
n AS (SELECT tenant_id, knowledge_base_id, source_uri, max(version) + 1 AS v FROM rag_documents GROUP BY 1, 2, 3), m AS (SELECT max(id) AS m FROM rag_documents)
SELECT m + dense_rank() OVER (ORDER BY o.id) AS id, o.source_uri, n.v::INT AS version, 'active' AS status FROM o JOIN n ON n.tenant_id = o.tenant_id AND n.source_uri = o.source_uri AND n.knowledge_base_id IS NOT DISTINCT FROM o.knowledge_base_id, m""")
def restore_version(spark, folder):
    docs = _documents(spark, folder)
    newest = store.latest_of_source(docs, ("superseded",)).select("id")
    first = docs.agg(F.max("id")).first()[0]
    restored, _ = store.restore(docs, load(spark, folder, "rag_chunks", "id", "document_id", "version", "status"), newest, first or 0)
    return restored.select("id", "source_uri", "version", "status")


@query("""SELECT c.id, CASE WHEN d.status = 'deleted' THEN 'deleted' ELSE c.status END AS status FROM (SELECT DISTINCT id, document_id, status FROM rag_chunks) c LEFT JOIN rag_documents d ON d.id = c.document_id""")
def delete_tree(spark, folder):
    chunks = load(spark, folder, "rag_chunks", "id", "document_id", "status").distinct()
    gone = _documents(spark, folder).where("status = 'deleted'").select(F.col("id").alias("document_id"))
    return store.with_status(chunks, gone, ["document_id"], "deleted").select("id", "status")


@query("""SELECT d.id, coalesce(k.default_department, d.department) AS department, coalesce(k.default_access_level, d.access_level) AS access_level FROM rag_documents d LEFT JOIN rag_knowledge_bases k ON k.id = d.knowledge_base_id""")
def metadata_patch(spark, folder):
    docs = _documents(spark, folder).select("id", "knowledge_base_id", "department", "access_level")
    defaults = load(spark, folder, "rag_knowledge_bases").select(F.col("id").alias("knowledge_base_id"), F.col("default_department").alias("department"), F.col("default_access_level").alias("access_level"))
    return store.patch(docs, defaults, "knowledge_base_id").select("id", "department", "access_level")


@query("""SELECT 'content_hash' AS rule, id::VARCHAR AS key FROM rag_documents WHERE NOT coalesce(regexp_matches(content_hash, '^[0-9a-f]{64}$'), false)
UNION ALL SELECT 'version', id::VARCHAR FROM rag_documents WHERE coalesce(version < 1, true) UNION ALL SELECT 'status', id::VARCHAR FROM rag_documents WHERE NOT coalesce(status IN ('active', 'superseded', 'deleted'), false)
UNION ALL SELECT 'one_active', source_uri FROM rag_documents WHERE status = 'active' AND knowledge_base_id IS NOT NULL GROUP BY tenant_id, knowledge_base_id, source_uri HAVING count(*) > 1
UNION ALL SELECT 'unique_version', concat_ws('#', source_uri, version::VARCHAR) FROM rag_documents WHERE knowledge_base_id IS NOT NULL GROUP BY tenant_id, knowledge_base_id, source_uri, version HAVING count(*) > 1""")
def store_violations(spark, folder):
    return store.violations(_documents(spark, folder))


@query("SELECT DISTINCT id FROM rag_chunks WHERE status = 'active' AND id NOT IN (SELECT chunk_id FROM vector_chunks WHERE embedding_model = 'text-embed-64')")
def backfill_candidates(spark, folder):
    chunks = load(spark, folder, "rag_chunks", "id", "status")
    return store.missing_vectors(chunks, load(spark, folder, "vector_chunks", "chunk_id", "embedding_model"), "text-embed-64").select("id").distinct()


@query("""SELECT k.id AS knowledge_base_id, k.name, k.status, coalesce(d.n, 0) AS documents, coalesce(c.n, 0) AS chunks, coalesce(epoch_us(d.last_update), -1) AS last_update, d.last_status FROM rag_knowledge_bases k
LEFT JOIN (SELECT knowledge_base_id, count(*) FILTER (WHERE status = 'active') AS n, max(updated_at) AS last_update, arg_max(status, (updated_at, id)) AS last_status FROM rag_documents GROUP BY 1) d ON d.knowledge_base_id = k.id
LEFT JOIN (SELECT knowledge_base_id, count(DISTINCT id) AS n FROM rag_chunks WHERE status = 'active' GROUP BY 1) c ON c.knowledge_base_id = k.id""")
def collection_stats(spark, folder):
    out = stats.collection_stats(load(spark, folder, "rag_knowledge_bases"), _documents(spark, folder), load(spark, folder, "rag_chunks", "id", "knowledge_base_id", "status"))
    return out.withColumn("last_update", F.coalesce(F.unix_micros("last_update"), F.lit(-1)))


@query("SELECT id AS knowledge_base_id, tag FROM rag_knowledge_bases, unnest(tags) AS t(tag)")
def collection_tags(spark, folder):
    return load(spark, folder, "rag_knowledge_bases", "id", "tags").select(F.col("id").alias("knowledge_base_id"), F.explode("tags").alias("tag"))


@query("""WITH d AS (SELECT DISTINCT package_id AS document_id FROM rag_documents), p AS (SELECT DISTINCT document_id, parent_id FROM parent_chunks), c AS (SELECT parent_key, count(DISTINCT id) AS n FROM rag_chunks GROUP BY 1)
SELECT d.document_id, count(p.parent_id) AS parents, coalesce(sum(c.n), 0)::BIGINT AS children, count(c.n) AS with_children FROM d LEFT JOIN p USING (document_id) LEFT JOIN c ON c.parent_key = p.parent_id GROUP BY 1""")
def chunk_tree(spark, folder):
    return stats.chunk_tree(_documents(spark, folder), load(spark, folder, "parent_chunks", "document_id", "parent_id"), load(spark, folder, "rag_chunks", "parent_key", "id"))


@query("""WITH c AS (SELECT DISTINCT chunk_key, parent_key, document_id, id FROM rag_chunks)
SELECT 'orphan_child' AS problem, chunk_key AS key FROM c WHERE NOT EXISTS (SELECT 1 FROM parent_chunks p WHERE p.parent_id = c.parent_key)
UNION ALL SELECT 'childless_parent', parent_id FROM (SELECT DISTINCT parent_id FROM parent_chunks) p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.parent_key = p.parent_id)
UNION ALL SELECT 'duplicate_key', chunk_key FROM c GROUP BY document_id, chunk_key HAVING count(*) > 1""")
def orphan_checks(spark, folder):
    return stats.orphans(load(spark, folder, "parent_chunks", "parent_id"), load(spark, folder, "rag_chunks", "chunk_key", "parent_key", "document_id", "id"))


@query("SELECT document_id, count(*) AS chunks, count(DISTINCT chunk_type) AS kinds FROM (SELECT DISTINCT id, document_id, chunk_type FROM rag_chunks) GROUP BY 1")
def stored_chunks(spark, folder):
    return load(spark, folder, "rag_chunks", "id", "document_id", "chunk_type").distinct().groupBy("document_id").agg(F.count("*").alias("chunks"), F.countDistinct("chunk_type").alias("kinds"))


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def latest_event(spark, folder):
    return stats.latest_per(load(spark, folder, "events", "event_id", "ts", "user_id", "event_type"), "user_id", "ts", "event_id", "event_type")


@query("SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_events(spark, folder):
    return stats.most_recent(load(spark, folder, "events", "event_id", "ts", "user_id", "event_type"), "ts", "event_id", 50)


@query("SELECT o_custkey, max(o_orderdate) AS o_orderdate, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def latest_order(spark, folder):
    return stats.latest_per(load(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, folder):
    return streaming.event_counts(load(spark, folder, "events", "ts", "event_type", "value"))


@query("""WITH m AS (SELECT user_id, event_id, ts, coalesce(epoch(ts) - epoch(lag(ts) OVER w) > 1800, false)::INT AS far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, (sum(far) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::INT AS session FROM m) SELECT user_id, session, min(ts) AS start, count(*) AS events FROM s GROUP BY 1, 2""")
def event_sessions(spark, folder):
    return stats.sessions(load(spark, folder, "events", "event_id", "ts", "user_id"))


@query()
def embed_missing(spark, folder):
    """A backfill with the built-in embedder over the chunks that have no vector."""
    from quern.operators.embed import embed

    chunks = load(spark, folder, "rag_chunks", "id", "status", "content").distinct()
    todo = store.missing_vectors(chunks, load(spark, folder, "vector_chunks", "chunk_id", "embedding_model"), "text-embed-64")
    return embed(todo, "id", "content")


_ID = "('0x' || substr(sha256(concat_ws(':', {})), 1, 15))::BIGINT"
_OLD = """o AS (SELECT * FROM rag_documents WHERE status = 'superseded' QUALIFY row_number() OVER (PARTITION BY tenant_id, knowledge_base_id, source_uri ORDER BY version DESC, id DESC) = 1),
n AS (SELECT tenant_id, knowledge_base_id, source_uri, max(version) + 1 AS v FROM rag_documents GROUP BY 1, 2, 3),
m AS (SELECT o.id AS old, """ + _ID.format("'document', o.id::VARCHAR, n.v::VARCHAR") + """ AS new, n.v FROM o JOIN n ON n.tenant_id = o.tenant_id AND n.source_uri = o.source_uri AND n.knowledge_base_id IS NOT DISTINCT FROM o.knowledge_base_id)"""


def _restored(spark, folder):
    docs = _documents(spark, folder)
    chunks = load(spark, folder, "rag_chunks", "id", "document_id", "parent_id", "version", "status").dropDuplicates(["id"])
    vectors = load(spark, folder, "vector_chunks", "chunk_id", "document_id", "parent_id", "embedding_model").distinct()
    packages = docs.select(F.col("package_id").alias("document_id"), F.col("id").alias("_doc"))
    parents = load(spark, folder, "parent_chunks", "id", "document_id", "title").dropDuplicates(["id"]).join(packages, "document_id").select("id", F.col("_doc").alias("document_id"), "title")
    return store.restore_tree(docs, parents, chunks, vectors, store.latest_of_source(docs, ("superseded",)).select("id"))


@query(f"""WITH {_OLD} SELECT {_ID.format("'chunk', m.new::VARCHAR, c.id::VARCHAR")} AS id, m.new AS document_id, {_ID.format("'parent', m.new::VARCHAR, c.parent_id::VARCHAR")} AS parent_id, m.v::INT AS version, 'active' AS status
FROM (SELECT DISTINCT id, document_id, parent_id FROM rag_chunks) c JOIN m ON m.old = c.document_id""")
def restored_chunks(spark, folder):
    return _restored(spark, folder)["chunks"]


@query(f"""WITH {_OLD} SELECT {_ID.format("'chunk', m.new::VARCHAR, c.chunk_id::VARCHAR")} AS chunk_id, m.new AS document_id, embedding_model FROM (SELECT DISTINCT chunk_id, document_id, embedding_model FROM vector_chunks) c JOIN m ON m.old = c.document_id""")
def restored_vectors(spark, folder):
    return _restored(spark, folder)["vectors"].select("chunk_id", "document_id", "embedding_model").distinct()


@query(f"""WITH {_OLD} SELECT DISTINCT {_ID.format("'parent', m.new::VARCHAR, p.id::VARCHAR")} AS id, m.new AS document_id FROM (SELECT DISTINCT id, document_id FROM parent_chunks) p JOIN rag_documents d ON d.package_id = p.document_id JOIN m ON m.old = d.id""")
def restored_parents(spark, folder):
    return _restored(spark, folder)["parents"].select("id", "document_id").distinct()


@query("SELECT DISTINCT id, tenant_id, status FROM rag_chunks WHERE tenant_id = (SELECT min(tenant_id) FROM rag_chunks) AND status IN ('active', 'superseded') AND id IN (SELECT chunk_id FROM ranked_candidates)")
def chunks_by_ids(spark, folder):
    rows = load(spark, folder, "rag_chunks", "id", "tenant_id", "status")
    tenant = rows.agg(F.min("tenant_id")).first()[0]
    wanted = load(spark, folder, "ranked_candidates", "chunk_id").withColumnRenamed("chunk_id", "id")
    return store.read(rows, tenant, ("active", "superseded"), wanted).distinct()


@query("SELECT DISTINCT id, parent_id, chunk_index FROM rag_chunks WHERE status = 'active' AND tenant_id = (SELECT min(tenant_id) FROM rag_chunks) AND parent_id IN (SELECT id FROM parent_chunks WHERE page_start = 1)")
def children_of_parents(spark, folder):
    rows = load(spark, folder, "rag_chunks", "id", "tenant_id", "parent_id", "chunk_index", "status")
    first = load(spark, folder, "parent_chunks", "id", "page_start").where("page_start = 1").select(F.col("id").alias("parent_id"))
    return store.read(rows, rows.agg(F.min("tenant_id")).first()[0], ids=first, on="parent_id").select("id", "parent_id", "chunk_index").distinct()


@query("""WITH s AS (SELECT tenant_id, knowledge_base_id, source_uri FROM rag_documents WHERE source_uri IS NOT NULL GROUP BY ALL ORDER BY count(*) DESC, source_uri, tenant_id, knowledge_base_id NULLS FIRST LIMIT 1)
SELECT d.id, d.version, d.status FROM rag_documents d, s WHERE d.tenant_id = s.tenant_id AND d.source_uri = s.source_uri AND d.knowledge_base_id IS NOT DISTINCT FROM s.knowledge_base_id""")
def version_history(spark, folder):
    """All versions of the source that has most of them."""
    docs = _documents(spark, folder)
    s = docs.where("source_uri is not null").groupBy(*store.SOURCE).count().orderBy(F.desc("count"), "source_uri", "tenant_id", F.asc_nulls_first("knowledge_base_id")).first()
    return store.versions_of(docs, s.tenant_id, s.knowledge_base_id, s.source_uri).select("id", "version", "status")
