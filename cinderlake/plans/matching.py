"""Ingest and matching on the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cinderlake.functions import text as T
from cinderlake.operators import ingest as I
from cinderlake.operators import matching as M
from cinderlake.operators.terms import terms_found
from cinderlake.session import table

EVENTS_AS_OF = "2024-01-31 00:00:00"
FAMILIES = [(1, ["Red_Widget", "red-wid get"], ["Brand#11"]), (2, ["nobody", "Hot Gear"], []), (3, ["none"], ["Brand#99", "Brand#17"]), (4, ["unknown"], [])]
WATCH = [(1, "license"), (2, "idiot"), (3, "@example"), (4, "the the"), (5, "zzzz")]
FUZZY = [{"id": 1, "name": "red widgets"}, {"id": 2, "name": "gear hot", "domain": "brand#11"}, {"id": 3, "name": "nothing like it", "keywords": "anvil, zz"}, {"id": 4, "name": "smal bolt"}]


def first_wins_dedup(spark, d):
    lines = table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    out = I.first_wins(lines, ["l_partkey", "l_shipdate"], ["l_orderkey", "l_linenumber", "l_suppkey"])
    return out.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))


def cross_source_duplicates(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return I.duplicates(docs, ["h"], ["doc_id"], "doc_id")


def insert_if_absent(spark, d):
    old = table(spark, d, "part").where("p_size > 25").select("p_brand", "p_type", "p_name")
    new = table(spark, d, "part").where("p_size <= 25").select("p_brand", "p_type", "p_name", "p_partkey")
    return I.insert_absent(old, new, ["p_brand", "p_type", "p_name"], ["p_partkey"])


def upsert_latest(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"), F.lit(None).cast("double").alias("spent"))
    new = table(spark, d, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("spent"))
    return I.upsert(old, new, ["k"])


def new_dimension_rows(spark, d):
    dim = table(spark, d, "documents").where("source < 'src3'").select("source").distinct().select("source", F.substring("source", 4, 9).cast("long").alias("id"))
    return I.get_or_create(dim, "source", "id", table(spark, d, "documents"))


def scd_history(spark, d):
    return I.history(table(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", "event_type", ["ts", "event_id"]).drop("ts")


def evidence_current(spark, d):
    e = table(spark, d, "events")
    latest = lambda df: df.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("payload"))
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    current, past = I.evidence(latest(e.where(F.col("ts") < cut)), latest(e.where(F.col("ts") >= cut)), ["user_id"], "payload")
    return current.withColumn("what", F.lit("current")).unionByName(past.withColumn("what", F.lit("past")))


def replace_children(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    new = c.where("role = 'assistant' AND turn >= 1").select("conv_id", "turn", F.lit("model").alias("role"))
    return I.replace_children(c, new, "conv_id")


def retention_purge(spark, d):
    return I.purge(table(spark, d, "events"), "ts", EVENTS_AS_OF, 10).select("event_id", "user_id")


def cascade_delete(spark, d):
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return I.cascade(table(spark, d, "orders"), gone, "o_custkey").select("o_orderkey", "o_custkey")


def anti_pending(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    pending = docs.where(F.length("text") > 0).join(labels.where("quality = 1"), "doc_id", "left_anti")
    return pending.join(labels.where("toxic = 1"), "doc_id", "left_anti").select("doc_id", "source")


def stratified_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return I.sample_per_group(docs, "source", [F.desc("n_chars"), "doc_id"], 5)


def freshness(spark, d):
    last = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last"))
    return last.select("user_id", "event_type", I.due(F.col("last"), EVENTS_AS_OF, "12 HOURS").alias("due"))


def name_keys(spark, d):
    part = table(spark, d, "part").select(F.concat_ws(" ", F.initcap("p_name"), F.when(F.col("p_size") > 40, "Group").when(F.col("p_size") > 30, "TEAM")).alias("name")).distinct()
    return part.select("name", T.name_key(F.col("name")).alias("k"), T.squashed(F.col("name")).alias("squashed"), T.stripped(F.col("name")).alias("stripped"), T.normal_name(F.col("name")).alias("normal"))


def alias_match_two_tier(spark, d):
    families = spark.createDataFrame(FAMILIES, "family int, names array<string>, addresses array<string>")
    part = table(spark, d, "part")
    by_address = part.groupBy(F.col("p_brand").alias("key")).agg(F.max("p_partkey").alias("target"))
    by_name = part.groupBy(T.normal_name(F.col("p_name")).alias("key")).agg(F.max("p_partkey").alias("target"))
    return M.match_two_tier(families, "family", "addresses", "names", by_address, by_name).fillna(-1, ["target"])


def alias_match(spark, d):
    left = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("names"))
    right = table(spark, d, "part").where("p_type = 'SMALL'").select("p_partkey", "p_name")
    return M.match_names(left, "p_brand", "names", right, "p_partkey", "p_name")


def watch_contains_join(spark, d):
    known = table(spark, d, "labels").where("toxic = 0").select(F.lit(2).alias("watch_id"), "doc_id")
    watch = spark.createDataFrame(WATCH, "watch_id int, term string")
    return M.watch_contains(table(spark, d, "documents"), "doc_id", F.col("text"), watch, known)


def relevance_terms(spark, d):
    given = spark.createDataFrame([(t,) for t in "license; Idiot, worthless;ab;the".replace(";", ",").split(",")], "term string")
    terms = given.select(F.lower(F.trim("term")).alias("term")).where("length(term) >= 3").distinct()
    found = terms_found(table(spark, d, "documents"), "doc_id", F.col("text"), terms.withColumn("id", F.col("term")), "id", "term")
    return found.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("found"))


def many_terms(spark, d):
    """How many documents have each word of the conversations (ten letters at least)."""
    words = table(spark, d, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{10,}"), F.lit(0))).alias("term")).distinct()
    found = terms_found(table(spark, d, "documents"), "doc_id", F.col("text"), words.withColumn("word", F.col("term")), "word", "term")
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


def whole_chains(spark, d):
    """Each order leads to the customer's next one; chains are followed to their ends."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return M.chain(o.withColumn("dst", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))), "o_orderkey", "dst", None)


def watch_fuzzy_join(spark, d):
    watch = spark.createDataFrame([(w["id"], w["name"], w.get("domain"), w.get("keywords")) for w in FUZZY], "watch_id int, name string, domain string, keywords string")
    return M.watch_fuzzy(table(spark, d, "part"), "p_partkey", "p_name", "p_brand", watch, 80)


def resolve_ladder(spark, d):
    part = table(spark, d, "part")
    actors = part.groupBy("p_name").agg(F.min("p_partkey").alias("actor_id"))
    aliases = part.groupBy(F.concat_ws(" ", "p_brand", "p_type").alias("alias")).agg(F.min("p_partkey").alias("first")).join(part.select(F.col("p_partkey").alias("first"), "p_name"), "first").join(actors, "p_name").select("alias", "actor_id")
    names = part.select(F.when(F.col("p_size") < 20, F.upper("p_name")).when(F.col("p_size") < 35, F.concat_ws(" ", "p_brand", "p_type")).otherwise(F.concat("p_name", F.lit("s"))).alias("name"))
    return M.resolve(names, "name", actors, "actor_id", "p_name", aliases)


def corroboration(spark, d):
    docs = table(spark, d, "documents").select(F.sha2(F.col("text"), 256).alias("h"), "source")
    return M.corroboration(docs, "h", "source")


def range_join(spark, d):
    spans = table(spark, d, "supplier").select(F.col("s_suppkey").alias("span"), (F.col("s_suppkey") * 1000).alias("lo"), (F.col("s_suppkey") * 1000 + F.floor("s_acctbal")).alias("hi")).where("hi >= lo")
    points = table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").alias("at"))
    return M.range_lookup(points, "at", spans, "lo", "hi", 10_000).groupBy("span").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))


def as_of_join(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    spans = e.where("event_type = 'signup'").groupBy("user_id", "at").agg(F.max("event_id").alias("x")).select("user_id", F.col("at").alias("lo"), (F.col("at") + 86_400_000_000).alias("hi"))
    out = M.as_of_span(e.where("event_type = 'purchase'").select("user_id", "event_id", "at"), "at", spans, "lo", "hi", "user_id")
    return out.select("user_id", "event_id", F.coalesce("span_lo", F.lit(-1)).alias("span_lo"))


def domain_suffix_join(spark, d):
    return M.suffix_match(table(spark, d, "pages"), "url", ["cheap-pills.example.com", "example.com", "example.org"]).select("page_id", "host", "platform")


def revocation_chain(spark, d):
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("k"))
    edges = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(last, "o_custkey").where("o_orderkey < k")
    nxt = edges.groupBy("o_orderkey").agg((F.floor((F.min("o_orderkey") + F.max("k") + 1) / 2)).alias("dst"))
    return M.chain(nxt, "o_orderkey", "dst")


def graph_routes(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") < 10, "group").when(F.col("p_size") < 30, "technique").otherwise("software").alias("kind"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("src"), F.max("l_partkey").alias("dst")).select("src", "dst").distinct()
    routes = M.route_edges(lines, nodes)
    out = None
    for name, df in routes.items():
        one = df.groupBy("src").agg(F.count(F.lit(1)).alias("n")).withColumn("route", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (
    first_wins_dedup, cross_source_duplicates, insert_if_absent, upsert_latest, new_dimension_rows, scd_history, evidence_current, replace_children, retention_purge, cascade_delete,
    anti_pending, stratified_sample, freshness, name_keys, alias_match_two_tier, alias_match, watch_contains_join, relevance_terms, many_terms, whole_chains, watch_fuzzy_join, resolve_ladder, corroboration,
    range_join, as_of_join, domain_suffix_join, revocation_chain, graph_routes,
)}

_NORMAL = "translate(lower(trim({})), ' -_', '')"
ORACLES = {
    "first_wins_dedup": """SELECT l_partkey, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate, l_orderkey, l_linenumber, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey, l_shipdate ORDER BY l_orderkey, l_linenumber, l_suppkey) = 1""",
    "cross_source_duplicates": "WITH m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS original FROM documents) SELECT doc_id AS duplicate, original FROM m WHERE doc_id <> original",
    "insert_if_absent": """SELECT p_brand, p_type, p_name, min(p_partkey) AS p_partkey FROM part n WHERE p_size <= 25
AND NOT EXISTS (SELECT 1 FROM part o WHERE o.p_size > 25 AND o.p_brand = n.p_brand AND o.p_type = n.p_type AND o.p_name = n.p_name) GROUP BY 1, 2, 3""",
    "upsert_latest": "SELECT coalesce(c_custkey, o.k) AS k, c_mktsegment AS segment, spent FROM customer FULL JOIN (SELECT o_custkey AS k, max(o_totalprice) AS spent FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) o ON c_custkey = o.k",
    "new_dimension_rows": """WITH d AS (SELECT DISTINCT source, CAST(substring(source, 4, 9) AS BIGINT) AS id FROM documents WHERE source < 'src3'),
n AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL AND source NOT IN (SELECT source FROM d))
SELECT (SELECT max(id) FROM d) + row_number() OVER (ORDER BY source) AS id, source FROM n""",
    "scd_history": """SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type""",
    "evidence_current": """WITH a AS (SELECT user_id, arg_max(event_type, event_id) AS payload FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1),
b AS (SELECT user_id, arg_max(event_type, event_id) AS payload FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(b.payload, a.payload) AS payload, 'current' AS what FROM a FULL JOIN b USING (user_id)
UNION ALL SELECT a.user_id, a.payload, 'past' FROM a JOIN b USING (user_id) WHERE a.payload <> b.payload""",
    "replace_children": """WITH n AS (SELECT conv_id, turn, 'model' AS role FROM conversations WHERE role = 'assistant' AND turn >= 1)
SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM n) UNION ALL SELECT * FROM n""",
    "retention_purge": "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-21'",
    "cascade_delete": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "anti_pending": "SELECT doc_id, source FROM documents WHERE length(text) > 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 OR toxic = 1)",
    "stratified_sample": "SELECT doc_id, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 5",
    "freshness": "SELECT user_id, event_type, max(ts) <= TIMESTAMP '2024-01-30 12:00:00' AS due FROM events GROUP BY 1, 2",
    "name_keys": """WITH p AS (SELECT DISTINCT array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ') || CASE WHEN p_size > 40 THEN ' Group' WHEN p_size > 30 THEN ' TEAM' ELSE '' END AS name FROM part)
SELECT name, lower(name) AS k, replace(lower(name), ' ', '') AS squashed, regexp_replace(lower(name), ' (group|team)$', '') AS stripped, replace(lower(name), ' ', '') AS normal FROM p""",
    "alias_match_two_tier": f"""WITH f AS (SELECT * FROM (VALUES {", ".join(f"({i}, {n!r}::VARCHAR[], {a!r}::VARCHAR[])" for i, n, a in FAMILIES)}) t(family, names, addresses)),
a AS (SELECT family, arg_min(target, pos) AS t FROM (SELECT family, unnest(addresses) AS key, unnest(range(len(addresses))) AS pos FROM f) JOIN (SELECT p_brand AS key, max(p_partkey) AS target FROM part GROUP BY 1) USING (key) GROUP BY 1),
n AS (SELECT family, arg_min(target, pos) AS t FROM (SELECT family, {_NORMAL.format("unnest(names)")} AS key, unnest(range(len(names))) AS pos FROM f) JOIN (SELECT {_NORMAL.format("p_name")} AS key, max(p_partkey) AS target FROM part GROUP BY 1) USING (key) GROUP BY 1)
SELECT CAST(f.family AS INTEGER) AS family, coalesce(a.t, n.t, -1) AS target, CASE WHEN a.t IS NOT NULL THEN 'address' WHEN n.t IS NOT NULL THEN 'name' END AS rung FROM f LEFT JOIN a USING (family) LEFT JOIN n USING (family)""",
    "alias_match": f"""WITH r AS (SELECT {_NORMAL.format("p_name")} AS k, max(p_partkey) AS id FROM part WHERE p_type = 'SMALL' GROUP BY 1), l AS (SELECT DISTINCT p_brand, p_name FROM part)
SELECT p_brand, arg_min(id, p_name) AS p_partkey FROM l JOIN r ON {_NORMAL.format("p_name")} = k GROUP BY 1""",
    "watch_contains_join": f"""SELECT CAST(w.id AS INTEGER) AS watch_id, doc_id FROM documents JOIN (VALUES {", ".join(f"({i}, '{t}')" for i, t in WATCH)}) w(id, term) ON contains(lower(text), term)
WHERE NOT (w.id = 2 AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0))""",
    "relevance_terms": """SELECT doc_id, string_agg(t, ',' ORDER BY t) AS found FROM documents JOIN (VALUES ('idiot'), ('license'), ('the'), ('worthless')) w(t) ON contains(lower(text), t) GROUP BY doc_id""",
    "many_terms": """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{10,}')) AS word FROM conversations)
SELECT word, count(*) AS n, min(doc_id) AS first FROM w JOIN documents ON contains(lower(text), word) GROUP BY word""",
    "whole_chains": """SELECT o_orderkey, max(o_orderkey) OVER (PARTITION BY o_custkey) AS target, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) - 1 AS n FROM orders
QUALIFY o_orderkey < max(o_orderkey) OVER (PARTITION BY o_custkey)""",
    "corroboration": "WITH o AS (SELECT DISTINCT sha256(text) AS h, source FROM documents WHERE text IS NOT NULL) SELECT h, source, count(source) OVER (PARTITION BY h) - CASE WHEN source IS NULL THEN 0 ELSE 1 END AS others FROM o",
    "range_join": """WITH s AS (SELECT s_suppkey AS span, s_suppkey * 1000 AS lo, s_suppkey * 1000 + CAST(floor(s_acctbal) AS BIGINT) AS hi FROM supplier)
SELECT span, count(*) AS n, min(o_orderkey) AS first FROM orders JOIN s ON floor(o_totalprice) BETWEEN lo AND hi WHERE hi >= lo GROUP BY span""",
    "as_of_join": """WITH p AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'), s AS (SELECT DISTINCT user_id, epoch_us(ts) AS lo FROM events WHERE event_type = 'signup')
SELECT p.user_id, event_id, CASE WHEN lo + 86400000000 >= t THEN lo ELSE -1 END AS span_lo FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.t >= s.lo""",
    "domain_suffix_join": """WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host FROM pages)
SELECT page_id, host, CASE WHEN host = 'cheap-pills.example.com' OR ends_with(host, '.cheap-pills.example.com') THEN 'cheap-pills.example.com' WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN 'example.com'
WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN 'example.org' END AS platform FROM h""",
    "revocation_chain": """WITH RECURSIVE k AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1), e AS (SELECT o_orderkey AS src, CAST(floor((o_orderkey + k + 1) / 2.0) AS BIGINT) AS dst FROM orders JOIN k USING (o_custkey) WHERE o_orderkey < k),
r AS (SELECT src, dst AS target, 1 AS n FROM e UNION ALL SELECT r.src, e.dst, r.n + 1 FROM r JOIN e ON r.target = e.src WHERE r.n < 10)
SELECT src AS o_orderkey, arg_max(target, n) AS target, CAST(max(n) AS INTEGER) AS n FROM r GROUP BY src""",
    "graph_routes": """WITH k AS (SELECT p_partkey AS id, CASE WHEN p_size < 10 THEN 'group' WHEN p_size < 30 THEN 'technique' ELSE 'software' END AS kind FROM part),
l AS (SELECT DISTINCT min(l_partkey) AS src, max(l_partkey) AS dst FROM lineitem GROUP BY l_orderkey)
SELECT src, count(*) AS n, a.kind || '>' || b.kind AS route FROM l JOIN k a ON src = a.id JOIN k b ON dst = b.id WHERE a.kind || '>' || b.kind IN ('group>technique', 'group>software', 'software>technique') GROUP BY src, route""",
}
