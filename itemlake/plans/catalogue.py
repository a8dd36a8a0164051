"""Registered queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemlake import model
from itemlake.functions import policy
from itemlake.operators import merkle, search, store, views
from itemlake.operators.search import Dialect
from itemlake.sources.shared import shared_dir, written
from itemlake.sources.views import doc_items, event_log, event_log_of, geo_items, table, turns, vec_items
from itemlake.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


# Search

DOCS = """WITH l AS (SELECT doc_id, max(quality) quality, max(toxic) toxic FROM labels GROUP BY doc_id),
d AS (SELECT 'crdt:docs:' || doc_id AS object_id, doc_id * 1000 AS updated_at, * FROM documents LEFT JOIN l USING (doc_id))
SELECT object_id FROM d WHERE """
TOKENS = r"string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+')"
HOT = Dialect(hot=True)


def _search(name: str, what: search.Query, where: str, dialect: Dialect = Dialect()) -> None:
    query(DOCS + where, name)(lambda spark, sf_dir: search.search(doc_items(spark, sf_dir), what, dialect).select("object_id"))


EN, LONG, TOXIC = search.text_eq("lang", "en"), search.between("n_chars", 2000, None), search.bool_eq("toxic", True)
_search("search_text_eq", EN, "lang = 'en'")
_search("search_numeric_eq", search.numeric_eq("quality", 1), "quality = 1")
_search("search_bool_eq", TOXIC, "toxic = 1")
_search("search_contains", search.contains("text", "the th"), "contains(text, 'the th')")
_search("search_range_closed", search.between("n_chars", 100, 2000), "n_chars BETWEEN 100 AND 2000")
_search("search_range_min", LONG, "n_chars >= 2000")
_search("search_range_max", search.between("n_chars", None, 500), "n_chars <= 500")
_search("search_range_open", search.between("n_chars"), "true")
_search("search_range_open_hot", search.between("quality"), "quality IS NOT NULL", HOT)
_search("search_tags_any", search.tags("tags", "fr", "src3"), "lang IN ('fr', 'src3') OR source IN ('fr', 'src3')")
_search("search_tags_scalar", search.tags("lang", "fr", "es"), "lang IN ('fr', 'es')")
_search("search_tags_none", search.tags("tags"), "false")
_search("search_prefix", search.prefix("source", "src1"), "starts_with(source, 'src1')")
_search("search_fuzzy_hot", search.fuzzy("source", "src1"), "levenshtein(source, 'src1') <= 1", HOT)
_search("search_fuzzy_cold", search.fuzzy("source", "rc1"), "contains(source, 'rc1')")
_search("search_hot_terms", search.text_eq("text", "The AND"), f"list_has_all({TOKENS.format('text')}, ['the', 'and'])", HOT)
_search("search_and", EN & search.between("n_chars", 100, 2000), "lang = 'en' AND n_chars BETWEEN 100 AND 2000")
_search("search_or", EN | search.prefix("source", "src2"), "lang = 'en' OR starts_with(source, 'src2')")
_search("search_not_cold", ~TOXIC, "NOT (toxic = 1)")
_search("search_not_hot", ~TOXIC, "NOT coalesce(toxic = 1, false)", HOT)
_search("search_nested", (EN | search.text_eq("lang", "de")) & LONG & ~search.contains("source", "9"), "lang IN ('en', 'de') AND n_chars >= 2000 AND NOT contains(source, '9')")
_search("search_all", search.ALL, "true")


@query("SELECT count(*) AS n FROM documents WHERE lang = 'en'")
def search_count(spark, sf_dir):
    return search.search(doc_items(spark, sf_dir), EN).agg(F.count("*").alias("n"))


@query("SELECT 'view:docs:' || doc_id AS object_id FROM documents WHERE lang = 'fr' AND starts_with('view:docs:' || doc_id, 'view:docs:1')")
def search_view_prefix(spark, sf_dir):
    views = doc_items(spark, sf_dir).withColumn("object_id", F.regexp_replace("object_id", "^crdt:", "view:")).withColumn("payload", F.concat(F.lit('{"data":'), "payload", F.lit("}")))
    return search.search(views, search.text_eq("lang", "fr"), Dialect(root="$.data"), search.view_prefix("crdt:docs:1")).select("object_id")


@query("SELECT 'crdt:docs:' || doc_id AS object_id, doc_id * 1000 AS updated_at FROM documents WHERE lang = 'en' ORDER BY updated_at DESC LIMIT 20")
def search_sorted_desc(spark, sf_dir):
    return search.search(doc_items(spark, sf_dir), EN).orderBy(F.desc("updated_at"), "object_id").limit(20).select("object_id", "updated_at")


@query("SELECT 'crdt:docs:' || doc_id AS object_id FROM documents WHERE contains(lower(text), 'tion') AND regexp_matches('crdt:docs:' || doc_id, '^crdt:docs:[0-9]*7$')")
def search_glob_grep(spark, sf_dir):
    found = doc_items(spark, sf_dir).filter(F.col("object_id").rlike("^crdt:docs:[0-9]*7$"))
    return found.filter(F.contains(F.lower(Dialect().text("text")), F.lit("tion"))).select("object_id")


# Vectors


def _nearest(name: str, metric: str, sql: str, where: search.Query = search.ALL, filter_sql: str = "true") -> None:
    v, q = "CAST(embedding AS DOUBLE[])", "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)"
    text = f"SELECT object_id, round(d, 6) + 0.0 AS vector_score FROM (SELECT 'vec:' || label || ':' || vec_id AS object_id, {sql.format(v=v, q=q)} AS d FROM embeddings WHERE {filter_sql} ORDER BY d, object_id LIMIT 10)"

    def run(spark, sf_dir):
        first = table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()
        return search.nearest(vec_items(spark, sf_dir), first.embedding, 10, metric, where).withColumn("vector_score", F.round("vector_score", 6))

    query(text, name)(run)


_nearest("knn_l2", "l2", "list_distance({v}, {q})")
_nearest("knn_ip", "ip", "1 - list_inner_product({v}, {q})")
_nearest("knn_cosine", "cosine", "1 - list_cosine_similarity({v}, {q})")
_nearest("knn_filtered", "l2", "list_distance({v}, {q})", search.numeric_eq("label", 3), "label = 3")


# Reads

GEO = """WITH g AS (SELECT 'crm.' || replace(lower(r_name), ' ', '_') || '.' || replace(lower(n_name), ' ', '_') || '.' || c_custkey AS object_id,
1 + c_custkey % 3 AS version, c_custkey * 1000 AS updated_at, lower(c_mktsegment) AS state, c_custkey, '{"name":"' || c_name || '","key":' || c_custkey || '}' AS payload
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


@query("SELECT vec_id AS pos, 'crdt:docs:' || (vec_id * 3) AS object_id, version FROM embeddings LEFT JOIN (SELECT doc_id, 1 + doc_id % 3 AS version FROM documents) ON doc_id = vec_id * 3")
def get_many(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.concat(F.lit("crdt:docs:"), (F.col("vec_id") * 3).cast("string")).alias("object_id"))
    return store.get_many(doc_items(spark, sf_dir), ids).select("pos", "object_id", "version")


@query("SELECT 'crdt:docs:' || doc_id AS object_id, doc_id % 7 <> 0 AS ok FROM documents")
def verify_content(spark, sf_dir):
    damaged = F.when(F.pmod(F.substring_index("object_id", ":", -1).cast("long"), F.lit(7)) == 0, F.concat(F.col("payload"), F.lit(" "))).otherwise(F.col("payload"))
    return model.verified(doc_items(spark, sf_dir).withColumn("payload", damaged)).select("object_id", "ok")


@query(GEO + "SELECT object_id, version FROM g WHERE starts_with(object_id, 'crm.asia.') ORDER BY object_id LIMIT 100")
def scan_prefix(spark, sf_dir):
    return store.scan_prefix(geo_items(spark, sf_dir), "crm.asia.", 100).select("object_id", "version")


@query(GEO + "SELECT object_id FROM g ORDER BY object_id LIMIT 25 OFFSET 50")
def scan_keys_page(spark, sf_dir):
    return store.scan_page(geo_items(spark, sf_dir), 50, 25).select("object_id")


@query(GEO + "SELECT object_id, updated_at FROM g ORDER BY updated_at, object_id LIMIT 50")
def scan_oldest(spark, sf_dir):
    return store.scan_oldest(geo_items(spark, sf_dir), 50).select("object_id", "updated_at")


@query(GEO + "SELECT object_id, version, sha256(payload) AS content_hash FROM g WHERE state = 'building'")
def state_items(spark, sf_dir):
    return store.in_state(geo_items(spark, sf_dir), "building").select("object_id", "version", "content_hash")


@query(GEO + "SELECT state, count(*) AS n FROM g GROUP BY state")
def state_counts(spark, sf_dir):
    return store.state_counts(geo_items(spark, sf_dir))


@query("SELECT 'conv.' || conv_id || '.' || turn AS object_id FROM conversations WHERE role = 'user'")
def state_ids(spark, sf_dir):
    return store.in_state(turns(spark, sf_dir), "user").select("object_id")


@query(GEO + "SELECT regexp_extract(object_id, '^[^.]*[.][^.]*[.][^.]*') AS prefix, count(*) AS n FROM g GROUP BY 1")
def count_prefix(spark, sf_dir):
    return store.prefix_counts(geo_items(spark, sf_dir), 3)


@query("SELECT 'page.' || page_id AS object_id, 'binary' AS content_type FROM pages UNION ALL SELECT 'event.' || event_id, CASE WHEN props IS NULL THEN 'binary' ELSE 'json' END FROM events UNION ALL SELECT 'doc.' || doc_id, CASE WHEN substr(ltrim(text), 1, 1) IN ('{', '[', '\"') AND json_valid(text) THEN 'json' ELSE 'binary' END FROM documents")
def content_type_detect(spark, sf_dir):
    sides = (("page", "pages", "page_id", "html"), ("event", "events", "event_id", "props"), ("doc", "documents", "doc_id", "text"))
    pages, events, docs = (table(spark, sf_dir, t).select(F.concat(F.lit(f"{p}."), F.col(i).cast("string")).alias("object_id"), F.col(c).alias("payload")) for p, t, i, c in sides)
    return pages.union(events).union(docs).select("object_id", model.content_type(F.col("payload")).alias("content_type"))


@query(GEO + "SELECT count(*) AS items, CAST(sum(256 + strlen(object_id) + strlen(payload) + 64) AS BIGINT) AS bytes FROM g")
def batch_totals(spark, sf_dir):
    g = geo_items(spark, sf_dir)
    return g.agg(F.count("*").alias("items"), F.sum(model.size_bytes(g)).alias("bytes"))


# Writes

LOG = """WITH e AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'DEL' ELSE 'PUT' END AS op, 'user.' || user_id || '.' || (event_id % 3) AS object_id,
props AS payload, sha256(props) AS content_hash, epoch_us(ts) // 1000 AS updated_at, user_id FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY seq DESC) AS rn FROM e)
"""


@query(LOG + "SELECT object_id, seq, content_hash, updated_at FROM r WHERE rn = 1 AND op = 'PUT'")
def upsert_latest(spark, sf_dir):
    return store.latest(event_log(spark, sf_dir), "object_id").filter(F.col("op") == "PUT").select("object_id", "seq", "content_hash", "updated_at")


@query(LOG + "SELECT object_id, seq, content_hash, updated_at FROM r WHERE rn = 1 AND op = 'PUT'")
def stream_upsert(spark, sf_dir):
    folder = f"{shared_dir(spark)}/itemlake/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 2)
    changes = event_log_of(files.parquet(f"{sf_dir}/events.parque[t]"))
    ingest.append_batches(changes, f"{folder}/log", f"{folder}/checkpoint")
    return ingest.current(spark, f"{folder}/log").select("object_id", "seq", "content_hash", "updated_at")


@query(GEO + """, n AS (SELECT *, c_custkey % 2 = 0 AS sent, CASE WHEN c_custkey % 4 = 0 THEN payload || ' ' ELSE payload END AS new_payload FROM g)
SELECT object_id, sha256(CASE WHEN sent THEN new_payload ELSE payload END) AS content_hash, sent AND (c_custkey % 4 = 0 OR c_custkey % 6 = 0) AS merkle_dirty FROM n""")
def upsert_dirty_flag(spark, sf_dir):
    base = geo_items(spark, sf_dir)
    key = F.substring_index("object_id", ".", -1).try_cast("long")
    changed = F.when(key % 4 == 0, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))
    sent = base.filter(key % 2 == 0).withColumn("payload", changed).withColumn("content_hash", F.sha2("payload", 256)).withColumn("version", F.when(key % 6 == 0, F.col("version") + 1).otherwise(F.col("version")))
    return store.upsert(base, sent).select("object_id", "content_hash", "merkle_dirty")


@query("""WITH o AS (SELECT event_id, user_id, event_type <> 'view' AS to_hot, CASE WHEN value > 50 THEN 60 ELSE 3600 END AS ttl FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY to_hot, ttl, user_id ORDER BY event_id DESC) AS rn FROM o)
SELECT to_hot, CAST(ttl AS INTEGER) AS ttl, user_id, event_id FROM r WHERE rn = 1""")
def flush_dedup_by_options(spark, sf_dir):
    options = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_type") != "view").alias("to_hot"), F.when(F.col("value") > 50, 60).otherwise(3600).alias("ttl"))
    return store.latest(options, "to_hot", "ttl", "user_id", order="event_id")


@query(GEO + "SELECT object_id FROM g WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def delete_ids(spark, sf_dir):
    ordered = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_custkey").distinct()
    g = geo_items(spark, sf_dir)
    ids = g.select("object_id", F.substring_index("object_id", ".", -1).try_cast("long").alias("o_custkey")).join(ordered, "o_custkey", "left_semi").select("object_id")
    return store.delete(g, ids).select("object_id")


@query(GEO + "SELECT object_id FROM g WHERE NOT starts_with(object_id, 'crm.europe.')")
def delete_prefix(spark, sf_dir):
    return store.delete_prefix(geo_items(spark, sf_dir), "crm.europe.").select("object_id")


@query(GEO + "SELECT object_id FROM g WHERE state <> 'machinery'")
def delete_state(spark, sf_dir):
    return store.delete_state(geo_items(spark, sf_dir), "machinery").select("object_id")


@query(GEO + "SELECT object_id, CASE WHEN version = 3 THEN 'merged' ELSE state END AS state FROM g")
def set_state(spark, sf_dir):
    return store.set_state(geo_items(spark, sf_dir), F.col("version") == 3, "merged").select("object_id", "state")


@query(GEO + "SELECT object_id, CASE WHEN state = 'household' AND version = 2 THEN 'archived' ELSE state END AS state FROM g")
def move_state(spark, sf_dir):
    return store.set_state(geo_items(spark, sf_dir), (F.col("state") == "household") & (F.col("version") == 2), "archived").select("object_id", "state")


# Existence

ASKED = "SELECT 'crdt:docs:' || (event_id * 2) AS object_id FROM events"


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.concat(F.lit("crdt:docs:"), (F.col("event_id") * 2).cast("string")).alias("object_id"))


@query(f"SELECT object_id, object_id IN (SELECT 'crdt:docs:' || doc_id FROM documents) AS found FROM ({ASKED})")
def exists(spark, sf_dir):
    return store.exists(doc_items(spark, sf_dir), _asked(spark, sf_dir))


@query(f"SELECT object_id FROM ({ASKED}) WHERE object_id NOT IN (SELECT 'crdt:docs:' || doc_id FROM documents)")
def definitely_missing(spark, sf_dir):
    return store.missing(doc_items(spark, sf_dir), _asked(spark, sf_dir))


@query(GEO + "SELECT object_id, c_custkey % 5 <> 0 AS current FROM g")
def is_current(spark, sf_dir):
    g = geo_items(spark, sf_dir)
    old = F.when(F.substring_index("object_id", ".", -1).try_cast("long") % 5 == 0, F.sha2("object_id", 256)).otherwise(F.col("content_hash"))
    return store.is_current(g, g.select("object_id", old.alias("known_hash")))


@query("SELECT 'crdt:docs:' || coalesce(d.doc_id, l.doc_id) AS object_id, d.doc_id IS NOT NULL AS in_archive, l.doc_id IS NOT NULL AS in_hot FROM documents d FULL JOIN (SELECT doc_id + 10 AS doc_id FROM (SELECT DISTINCT doc_id FROM labels)) l ON d.doc_id = l.doc_id")
def item_status(spark, sf_dir):
    hot = table(spark, sf_dir, "labels").select("doc_id").distinct().select(F.concat(F.lit("crdt:docs:"), (F.col("doc_id") + 10).cast("string")).alias("object_id"))
    return store.status(hot, doc_items(spark, sf_dir))


# Routing, lifetimes, change data

ROUTES = {"crm.": "crm_items", "crm.asia.": "asia_items", "crm.asia.nation_1": "first_items"}
ROUTE_SQL = "CASE WHEN starts_with(object_id, 'crm.asia.nation_1') THEN 'first_items' WHEN starts_with(object_id, 'crm.asia.') THEN 'asia_items' WHEN starts_with(object_id, 'crm.') THEN 'crm_items' ELSE 'sync_items' END"


@query(GEO + f"SELECT object_id, {ROUTE_SQL} AS route FROM g")
def route_keys(spark, sf_dir):
    return geo_items(spark, sf_dir).select("object_id", store.route(F.col("object_id"), ROUTES).alias("route"))


@query(GEO + f"SELECT {ROUTE_SQL} AS route, count(*) AS n FROM g GROUP BY 1")
def route_counts(spark, sf_dir):
    return geo_items(spark, sf_dir).groupBy(store.route(F.col("object_id"), ROUTES).alias("route")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN s <= 90 THEN 60 WHEN s <= 450 THEN 300 WHEN s <= 2700 THEN 900 WHEN s <= 5400 THEN 3600 WHEN s <= 129600 THEN 86400 WHEN s <= 864000 THEN 604800 ELSE s END AS ttl FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 3) AS BIGINT) AS s FROM orders)")
def ttl_snap(spark, sf_dir):
    seconds = F.floor(F.col("o_totalprice") * 3)
    return table(spark, sf_dir, "orders").select("o_orderkey", policy.snapped_ttl(seconds).cast("long").alias("ttl"))


@query(LOG + "SELECT seq, op, object_id AS key, CASE WHEN op = 'PUT' THEN content_hash END AS hash, CASE WHEN op = 'PUT' THEN updated_at END AS updated_at FROM e")
def cdc_log(spark, sf_dir):
    return store.cdc_log(event_log(spark, sf_dir)).drop("data")


@query(LOG + "SELECT object_id AS key, seq, content_hash AS hash, updated_at FROM r WHERE rn = 1 AND op = 'PUT'")
def cdc_apply(spark, sf_dir):
    return store.apply_cdc(store.cdc_log(event_log(spark, sf_dir)))


@query(LOG + "SELECT seq, op, object_id AS key FROM e ORDER BY seq DESC LIMIT 500")
def cdc_trim(spark, sf_dir):
    return store.trimmed(store.cdc_log(event_log(spark, sf_dir)), 500).select("seq", "op", "key")


# Hash trees

LEAF = "sha256(unhex(hex(object_id) || '7C' || lpad(to_hex(version), 2, '0') || '00000000000000' || '7C' || sha256(payload)))"
UP = "sha256(unhex(string_agg(hex(regexp_extract(path, '[^.]*$') || ':') || merkle_hash || '3B', '' ORDER BY regexp_extract(path, '[^.]*$'))))"
TREE = GEO + f""", t4 AS (SELECT object_id AS path, {LEAF} AS merkle_hash, 0 AS object_count FROM g),
t3 AS (SELECT regexp_replace(path, '[.][^.]*$', '') AS path, {UP} AS merkle_hash, count(*) AS object_count FROM t4 GROUP BY 1),
t2 AS (SELECT regexp_replace(path, '[.][^.]*$', '') AS path, {UP} AS merkle_hash, count(*) AS object_count FROM t3 GROUP BY 1),
t1 AS (SELECT regexp_replace(path, '[.][^.]*$', '') AS path, {UP} AS merkle_hash, count(*) AS object_count FROM t2 GROUP BY 1),
t0 AS (SELECT '' AS path, {UP} AS merkle_hash, count(*) AS object_count FROM t1),
tree AS (SELECT * FROM t4 UNION ALL SELECT * FROM t3 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t0)
"""


def _tree(spark, sf_dir):
    return merkle.build(merkle.leaves(geo_items(spark, sf_dir)))


@query(GEO + f"SELECT object_id AS path, {LEAF} AS hash FROM g")
def merkle_leaves(spark, sf_dir):
    return merkle.leaves(geo_items(spark, sf_dir))


@query(TREE + "SELECT path, merkle_hash, object_count FROM tree")
def merkle_nodes(spark, sf_dir):
    return _tree(spark, sf_dir).select("path", "merkle_hash", "object_count")


@query(TREE + "SELECT merkle_hash FROM t0")
def merkle_root(spark, sf_dir):
    return _tree(spark, sf_dir).filter("path = ''").select("merkle_hash")


@query(TREE + "SELECT path, merkle_hash FROM t2")
def merkle_children(spark, sf_dir):
    return _tree(spark, sf_dir).filter("parent_path = 'crm'").select("path", "merkle_hash")


@query(TREE + "SELECT path FROM t4 WHERE path LIKE 'crm.asia.nation_2.%'")
def merkle_leaves_under(spark, sf_dir):
    return merkle.under(_tree(spark, sf_dir), "crm.asia.nation_2").select("path")


def _remote(spark, sf_dir):
    """A replica in which some customers are of another version and some are missing."""
    key = F.substring_index("object_id", ".", -1).try_cast("long")
    other = geo_items(spark, sf_dir).filter(key % 97 != 0)
    return other.withColumn("version", F.when(key % 89 == 0, F.col("version") + 10).otherwise(F.col("version")))


@query(GEO + "SELECT object_id AS path, CASE WHEN c_custkey % 97 = 0 THEN 'local_only' ELSE 'divergent' END AS kind FROM g WHERE c_custkey % 97 = 0 OR c_custkey % 89 = 0")
def merkle_drilldown(spark, sf_dir):
    return merkle.drill_down(_tree(spark, sf_dir), merkle.build(merkle.leaves(_remote(spark, sf_dir))))


@query(GEO + """, x AS (SELECT * FROM g WHERE c_custkey % 97 = 0 OR c_custkey % 89 = 0), gone AS (SELECT regexp_replace(object_id, '[.][^.]*$', '') p FROM g GROUP BY 1 HAVING bool_and(c_custkey % 97 = 0))
SELECT object_id AS path, CASE WHEN c_custkey % 97 = 0 THEN 'local_only' ELSE 'divergent' END AS kind FROM x
UNION SELECT regexp_replace(object_id, '[.][^.]*$', ''), CASE WHEN regexp_replace(object_id, '[.][^.]*$', '') IN (SELECT p FROM gone) THEN 'local_only' ELSE 'divergent' END FROM x
UNION SELECT regexp_replace(object_id, '[.][^.]*[.][^.]*$', ''), 'divergent' FROM x UNION SELECT 'crm', 'divergent' FROM x UNION SELECT '', 'divergent' FROM x""")
def merkle_diff(spark, sf_dir):
    return merkle.diff(_tree(spark, sf_dir), merkle.build(merkle.leaves(_remote(spark, sf_dir))))


@query(TREE.replace("1 + c_custkey % 3 AS version", "CASE WHEN c_custkey % 89 = 0 THEN 10 ELSE 0 END + 1 + c_custkey % 3 AS version").replace("FROM g),", "FROM g WHERE c_custkey % 97 <> 0),", 1) + "SELECT path, merkle_hash, object_count FROM tree")
def merkle_update(spark, sf_dir):
    """The tree after the replica's changes, by building the branches that hold one."""
    ours, theirs = merkle.leaves(geo_items(spark, sf_dir)), merkle.leaves(_remote(spark, sf_dir))
    changed = theirs.join(ours, ["path", "hash"], "left_anti")
    deleted = ours.join(theirs, "path", "left_anti").select("path")
    return merkle.update(merkle.build(ours), changed, deleted).select("path", "merkle_hash", "object_count")


@query("SELECT DISTINCT 'user' || (user_id % 50) AS prefix FROM events WHERE event_type = 'click'")
def dirty_prefixes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    key = F.concat(F.lit("user"), (F.col("user_id") % 50).cast("string"), F.lit("."), F.col("event_id").cast("string"))
    return merkle.dirty_prefixes(e.select(key.alias("object_id"), (F.col("event_type") == "click").alias("merkle_dirty")))


DIRTY = GEO + ", f AS (SELECT *, c_custkey % 7 = 0 AS merkle_dirty FROM g) "


def _flagged(spark, sf_dir):
    return geo_items(spark, sf_dir).withColumn("merkle_dirty", F.substring_index("object_id", ".", -1).try_cast("long") % 7 == 0)


@query(DIRTY + "SELECT object_id, version FROM f WHERE merkle_dirty ORDER BY object_id LIMIT 100")
def dirty_scan(spark, sf_dir):
    return store.dirty(_flagged(spark, sf_dir), 100).select("object_id", "version")


@query(DIRTY + "SELECT object_id, merkle_dirty AND state <> 'building' AS merkle_dirty FROM f")
def mark_clean(spark, sf_dir):
    f = _flagged(spark, sf_dir)
    return store.mark_clean(f, store.in_state(f, "building").select("object_id")).select("object_id", "merkle_dirty")


@query("""WITH h AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)
SELECT 'crdt:docs:' || coalesce(h.doc_id, d.doc_id) AS object_id, CASE WHEN h.doc_id IS NULL THEN 'archive' ELSE 'hot' END AS tier
FROM (SELECT * FROM h WHERE quality IS NULL OR doc_id % 4 > 1) h FULL JOIN documents d USING (doc_id)""")
def tiered_get(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    key = F.concat(F.lit("crdt:docs:"), F.col("doc_id").cast("string")).alias("object_id")
    hot = labels.select(key, F.when(F.col("quality").isNotNull(), F.col("doc_id") % 4).alias("expires_at"))
    return store.tiered(hot, doc_items(spark, sf_dir).select("object_id"), F.lit(1)).select("object_id", "tier")


@query("SELECT 'crdt:docs:' || doc_id AS object_id, 'old' AS origin FROM documents UNION ALL SELECT 'crdt:docs:' || (event_id * 2), 'new' FROM events WHERE event_id * 2 NOT IN (SELECT doc_id FROM documents)")
def get_or_insert(spark, sf_dir):
    held = doc_items(spark, sf_dir).select("object_id", "version", F.lit("old").alias("origin"))
    asked = _asked(spark, sf_dir).select("object_id", F.lit(1).cast("long").alias("version"), F.lit("new").alias("origin"))
    return store.get_or_insert(held, asked).select("object_id", "origin")


@query(GEO + """, b AS (SELECT regexp_extract(object_id, '^crm[.][^.]*') AS branch, c_custkey % 1000 = 999 AS dirty FROM g) SELECT branch FROM b GROUP BY branch HAVING NOT bool_or(dirty)""")
def clean_branches(spark, sf_dir):
    g = geo_items(spark, sf_dir).withColumn("branch", F.substring_index("object_id", ".", 2))
    dirty = g.filter(F.substring_index("object_id", ".", -1).try_cast("long") % 1000 == 999)
    return g.select("branch").distinct().join(dirty, "branch", "left_anti")


@query("""WITH p AS (SELECT DISTINCT 'conv.' || conv_id || '.' || turn AS a, 'conv.' || conv_id AS b FROM conversations)
SELECT path FROM (SELECT a AS path FROM p UNION SELECT b FROM p UNION SELECT 'conv' FROM p)""")
def affected_paths(spark, sf_dir):
    return merkle.affected(turns(spark, sf_dir).select(F.col("object_id").alias("path")))


# Policies

USED = "l_discount * 8 + l_tax * 4"
MULTIPLIER = f"CASE WHEN u <= 0.75 THEN 1.0 WHEN u >= 0.95 THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - (tan((u - 0.5) * pi() / 1.2) + 2) / 4)) END"


def _entries(spark, sf_dir):
    used = F.col("l_discount") * 8 + F.col("l_tax") * 4
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", used.alias("u"), (F.col("l_orderkey") % 7200).cast("double").alias("idle"), (F.col("l_partkey") % 1500).alias("accesses"), (F.col("l_extendedprice") * 100).alias("size"))


@query(f"SELECT l_orderkey, l_linenumber, round({MULTIPLIER}, 6) AS multiplier FROM (SELECT *, {USED} AS u FROM lineitem)")
def evict_multiplier(spark, sf_dir):
    return _entries(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(policy.keep_multiplier(F.col("u")), 6).alias("multiplier"))


SCORES = f"""WITH s AS (SELECT l_orderkey, l_linenumber, (0.4 * exp(-(l_orderkey % 7200) / 3600.0) + 0.4 * CASE WHEN l_partkey % 1500 = 0 THEN 0 ELSE ln(1 + least(l_partkey % 1500, 1000)) / ln(1001) END
+ 0.2 / (1 + l_extendedprice * 100 / 1048576.0)) * ({MULTIPLIER.replace('u ', '0.8 ').replace('(u', '(0.8')}) AS score FROM lineitem)
"""


def _scored(spark, sf_dir):
    e = _entries(spark, sf_dir)
    score = policy.keep_score(F.col("idle"), F.col("accesses"), F.col("size"), F.lit(0.8))
    return e.select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


@query(SCORES + "SELECT l_orderkey, l_linenumber, round(score, 6) AS score FROM s")
def evict_score(spark, sf_dir):
    return _scored(spark, sf_dir)


@query(SCORES + "SELECT l_orderkey, l_linenumber FROM s WHERE l_linenumber <> 3 ORDER BY round(score, 6), l_orderkey, l_linenumber LIMIT 200")
def evict_victims(spark, sf_dir):
    entries = _scored(spark, sf_dir).withColumn("key", F.struct("l_orderkey", "l_linenumber")).withColumn("dirty", F.col("l_linenumber") == 3)
    return policy.victims(entries, F.col("score"), 200).select("l_orderkey", "l_linenumber")


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, {USED} AS u FROM lineitem), q AS (SELECT *, CASE WHEN u < 0.7 THEN 'normal' WHEN u < 0.8 THEN 'warn' WHEN u < 0.9 THEN 'throttle' WHEN u < 0.95 THEN 'critical' WHEN u < 0.98 THEN 'emergency' ELSE 'shutdown' END AS level FROM p)
SELECT l_orderkey, l_linenumber, level, level IN ('normal', 'warn', 'throttle') AS writes, CASE level WHEN 'throttle' THEN 1 WHEN 'critical' THEN 5 WHEN 'emergency' THEN 30 WHEN 'shutdown' THEN 30 END AS retry_after FROM q""")
def pressure_levels(spark, sf_dir):
    level = policy.pressure_level(F.col("u"))
    e = _entries(spark, sf_dir).select("l_orderkey", "l_linenumber", level.alias("level"))
    return e.withColumns({"writes": policy.accepts_writes(F.col("level")), "retry_after": policy.by_level(F.col("level"), policy.RETRY_AFTER)})


# Typed views

DOC_FIELDS = (views.Field("lang", "text"), views.Field("n_chars", "number"), views.Field("tags", "tags"), views.Field("toxic", "boolean"), views.Field("quality", "number"))


def _view(name: str, what: search.Query, where: str) -> None:
    query(DOCS + where, name)(lambda spark, sf_dir: search.search(written(views.typed(doc_items(spark, sf_dir), *DOC_FIELDS), "view"), what, views.Typed()).select("object_id"))


_view("view_text_range", EN & search.between("n_chars", 100, 2000), "lang = 'en' AND n_chars BETWEEN 100 AND 2000")
_view("view_tags", search.tags("tags", "fr", "src3"), "lang IN ('fr', 'src3') OR source IN ('fr', 'src3')")
_view("view_boolean_or_number", TOXIC | search.numeric_eq("quality", 1), "toxic = 1 OR quality = 1")


@query(DOCS.replace("SELECT object_id FROM", "SELECT object_id, updated_at, lang FROM") + "lang = 'en' ORDER BY updated_at DESC, object_id LIMIT 50")
def view_sorted(spark, sf_dir):
    view = views.typed(doc_items(spark, sf_dir), *DOC_FIELDS[:1])
    return search.search(view, EN, views.Typed()).orderBy(F.desc("updated_at"), "object_id").limit(50)


@query("""WITH p AS (SELECT c_custkey, (c_custkey * 7) % 400 - 200 AS lon, (c_custkey * 11) % 170 - 85 AS lat FROM customer),
m AS (SELECT *, 2 * 6371000.0 * asin(sqrt(pow(sin(radians(lat - 48) / 2), 2) + cos(radians(48)) * cos(radians(lat)) * pow(sin(radians(lon - 16) / 2), 2))) AS metres FROM p WHERE lon BETWEEN -180 AND 180)
SELECT 'crm.' || c_custkey AS object_id, CAST(round(metres) AS BIGINT) AS metres FROM m WHERE metres <= 2000000""")
def view_geo_radius(spark, sf_dir):
    """Customers at places made of their keys; those off the map have none."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    place = F.concat((key * 7 % 400 - 200).cast("string"), F.lit(","), (key * 11 % 170 - 85).cast("string"))
    items = model.items(c, F.concat(F.lit("crm."), key.cast("string")), F.to_json(F.struct(place.alias("at"))), F.lit(1), key)
    metres = views.metres(F.col("at"), 16.0, 48.0)
    return views.typed(items, views.Field("at", "geo")).select("object_id", metres.alias("m")).filter("m <= 2000000").select("object_id", F.round("m").cast("long").alias("metres"))


@query("SELECT 'vec:' || vec_id AS object_id, CASE WHEN vec_id % 5 <> 0 THEN 3 END AS n FROM embeddings")
def view_vector_dim(spark, sf_dir):
    """Vectors of the first three components, some cut to two: those of another size are null."""
    e = table(spark, sf_dir, "embeddings")
    vector = F.slice("embedding", F.lit(1), F.when(F.col("vec_id") % 5 == 0, 2).otherwise(3))
    items = model.items(e, F.concat(F.lit("vec:"), F.col("vec_id").cast("string")), F.to_json(F.struct(vector.alias("v"))), F.lit(1), F.col("vec_id"))
    v = F.col("v")
    return views.typed(items, views.Field("v", "vector", dim=3)).select("object_id", F.when(v.isNotNull(), F.size(v)).alias("n"))


# Batches, change entries and replicas


@query("SELECT CASE WHEN doc_id::VARCHAR LIKE '1%' THEN 'docs_one' ELSE 'docs' END AS route, count(*) AS n_written, count(*) AS n_verified FROM documents GROUP BY 1")
def batch_write_routed(spark, sf_dir):
    path = f"{shared_dir(spark)}/itemlake/batch-{uuid.uuid4().hex}"
    return store.write_routed(doc_items(spark, sf_dir), {"crdt:docs:": "docs", "crdt:docs:1": "docs_one"}, path)


@query("SELECT event_id AS pos, 'crdt:docs:' || (event_id * 2) AS object_id, event_id * 2 IN (SELECT doc_id FROM documents) AS found FROM events")
def exists_in_order(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.concat(F.lit("crdt:docs:"), (F.col("event_id") * 2).cast("string")).alias("object_id"))
    return store.exists(doc_items(spark, sf_dir), asked)


@query(LOG + """, l AS (SELECT * FROM r WHERE rn = 1) SELECT 'hot' AS tier, count(*) AS n, sum(seq) AS seqs FROM l WHERE seq % 3 <> 0
UNION ALL SELECT 'archive', count(*), sum(seq) FROM l WHERE seq % 3 <> 1""")
def flush_split(spark, sf_dir):
    batch = event_log(spark, sf_dir).withColumns({"to_hot": F.col("seq") % 3 != 0, "to_archive": F.col("seq") % 3 != 1})
    hot, archive = (d.agg(F.count("*").alias("n"), F.sum("seq").alias("seqs")) for d in store.split_flush(batch))
    return hot.select(F.lit("hot").alias("tier"), "n", "seqs").union(archive.select(F.lit("archive"), "n", "seqs"))


def _edited(spark, sf_dir):
    """Customers after edits: some of other content, some of another version alone, some gone."""
    key = F.substring_index("object_id", ".", -1).try_cast("long")
    g = geo_items(spark, sf_dir).filter(key % 97 != 0)
    payload = F.when(key % 89 == 0, F.lit("{}")).otherwise(F.col("payload"))
    return g.withColumns({"payload": payload, "content_hash": F.sha2(payload, 256), "version": F.when(key % 2 == 0, F.col("version") + 5).otherwise(F.col("version"))})


@query(GEO + "SELECT CASE WHEN c_custkey % 97 = 0 THEN 'DEL' ELSE 'PUT' END AS op, object_id AS key, CASE WHEN c_custkey % 97 <> 0 THEN sha256('{}') END AS hash FROM g WHERE c_custkey % 97 = 0 OR c_custkey % 89 = 0")
def cdc_emit(spark, sf_dir):
    return store.emitted(geo_items(spark, sf_dir), _edited(spark, sf_dir)).select("op", "key", "hash")


@query(GEO + "SELECT object_id, CASE WHEN c_custkey % 89 = 0 THEN sha256('{}') ELSE sha256(payload) END AS content_hash, version + CASE WHEN c_custkey % 89 = 0 AND c_custkey % 2 = 0 THEN 5 ELSE 0 END AS version, c_custkey % 89 = 0 AS changed FROM g WHERE c_custkey % 97 <> 0")
def cdc_apply_to_base(spark, sf_dir):
    base = geo_items(spark, sf_dir)
    return store.applied(base, store.emitted(base, _edited(spark, sf_dir))).select("object_id", "content_hash", "version", "changed")


@query(DIRTY + "SELECT regexp_extract(object_id, '^crm[.][^.]*[.][^.]*') AS branch, count(*) AS n, count(*) FILTER (merkle_dirty) AS n_dirty, count(*) FILTER (merkle_dirty) = 0 AS clean FROM f GROUP BY 1")
def branch_dirty_counts(spark, sf_dir):
    return store.branches(_flagged(spark, sf_dir), 3)


@query(GEO + "SELECT object_id, CASE WHEN state = 'building' THEN 'default' ELSE state END AS state FROM g")
def remove_state(spark, sf_dir):
    return store.without_state(geo_items(spark, sf_dir), F.col("state") == "building").select("object_id", "state")


@query("SELECT 'crdt:docs:' || doc_id AS object_id, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 2000")
def hits_fetch(spark, sf_dir):
    """Ids that a view finds, with the items' own rows."""
    docs = doc_items(spark, sf_dir)
    hits = search.search(views.typed(docs, *DOC_FIELDS[:2]), EN & LONG, views.Typed()).select("object_id")
    return hits.join(docs, "object_id").select("object_id", Dialect().number("n_chars").cast("long").alias("n_chars"))


@query("SELECT 'conv.' || conv_id || '.' || turn AS object_id, strlen(text) <= 200 AS accepted FROM conversations")
def payload_limit(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    key = F.concat(F.lit("conv."), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"))
    return store.within_limit(model.items(t, key, F.col("text"), F.lit(1), F.col("turn")), 200).select("object_id", "accepted")


# Trees of replicas


@query(GEO + "SELECT DISTINCT regexp_extract(object_id, '^crm[.][^.]*') AS path, 'divergent' AS kind FROM g WHERE c_custkey % 97 = 0 OR c_custkey % 89 = 0")
def merkle_diff_children(spark, sf_dir):
    return merkle.diff_children(_tree(spark, sf_dir), merkle.build(merkle.leaves(_remote(spark, sf_dir))), "crm")


@query(GEO + "SELECT object_id, version FROM g WHERE c_custkey % 97 = 0 OR c_custkey % 89 = 0")
def merkle_resync(spark, sf_dir):
    theirs = merkle.build(merkle.leaves(_remote(spark, sf_dir)))
    return merkle.resync(geo_items(spark, sf_dir), _tree(spark, sf_dir), theirs).select("object_id", "version")


@query(TREE + "SELECT 0 AS tree, merkle_hash FROM t0 UNION ALL SELECT 1, merkle_hash FROM t0")
def merkle_roots(spark, sf_dir):
    """The roots of two tiers that hold the same items, one of them in another order and with other times."""
    other = geo_items(spark, sf_dir).withColumn("updated_at", F.col("updated_at") + 1).orderBy(F.desc("object_id"))
    return merkle.roots(_tree(spark, sf_dir), merkle.build(merkle.leaves(other)))


@query(f"""WITH q AS (SELECT *, CASE WHEN u < 0.7 THEN 'normal' WHEN u < 0.8 THEN 'warn' WHEN u < 0.9 THEN 'throttle' WHEN u < 0.95 THEN 'critical' WHEN u < 0.98 THEN 'emergency' ELSE 'shutdown' END AS level FROM (SELECT {USED} AS u FROM lineitem))
SELECT level, count(*) AS n FROM q GROUP BY level""")
def pressure_counts(spark, sf_dir):
    return _entries(spark, sf_dir).groupBy(policy.pressure_level(F.col("u")).alias("level")).agg(F.count("*").alias("n"))
