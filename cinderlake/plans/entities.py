"""Identities, address ranges and exports on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderlake.functions.text import name_key
from cinderlake.operators import addresses as N
from cinderlake.operators import exports as E
from cinderlake.operators import identity as D
from cinderlake.session import dealt, table

#: Rows of ``lineitem`` of a task; more rows, more tasks.
TASK_LINES = 500_000


def _names(spark, d):
    """Names in vendors' forms, from part names: one word, two words, numbers, other words."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_brand")
    return p.select(
        "p_partkey",
        F.when(F.col("p_size") < 10, F.concat(F.lit("Storm-"), F.col("p_partkey") + 1000)).when(F.col("p_size") < 15, F.concat(F.lit("UNC"), F.col("p_partkey") + 100)).when(F.col("p_size") < 20, F.concat(F.lit("Fox "), F.lit("TEMPEST")))
        .when(F.col("p_size") < 25, F.concat(F.lit("Iron "), F.split("p_name", " ")[1])).when(F.col("p_size") < 35, F.concat(F.col("p_name"), F.lit(" Group"))).otherwise(F.col("p_name")).alias("name"),
    )


def designators(spark, d):
    return _names(spark, d).select("p_partkey", "name", D.designator(F.col("name")).alias("authority"))


def naming_schemes(spark, d):
    s = _names(spark, d).select("p_partkey", D.naming_scheme(F.col("name")).alias("s"))
    return s.where("s IS NOT NULL").select("p_partkey", "s.vendor", "s.encodes")


def identity_ladder(spark, d):
    part = table(spark, d, "part")
    held = part.where("p_type = 'ECONOMY'").groupBy("p_name").agg(F.min("p_partkey").alias("ordinal"))
    entries = held.select(F.lit(0).alias("precedence"), "ordinal", F.col("p_name").alias("canonical"), F.lit("own").alias("authority"), F.array("p_name", F.concat_ws("-", F.split("p_name", " "))).alias("names"))
    malware = part.where("p_type = 'SMALL'").select(name_key(F.col("p_name")).alias("key"), F.upper("p_name").alias("canonical")).distinct()
    tools = part.where("p_type = 'LARGE'").select(name_key(F.col("p_name")).alias("key"), F.upper("p_name").alias("canonical")).distinct()
    return D.resolve_identity(_names(spark, d), "name", D.catalogue(entries), malware, tools)


def catalogue_keys(spark, d):
    part = table(spark, d, "part").select((F.col("p_size") % 3).alias("precedence"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("canonical"), F.col("p_brand").alias("authority"), F.array("p_name").alias("names"))
    return D.catalogue(part)


def tactic_matrix(spark, d):
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.element_at(F.array(*map(F.lit, (*D.TACTICS, "Other"))), (F.col("l_linenumber") % 15 + 1).cast("int")).alias("tactic"))
    # dealt by part before anything is counted, so that no task holds more groups than its share of rows
    lines = dealt(lines, TASK_LINES, "l_partkey", "tactic")
    out = lines.groupBy("tactic", "l_partkey").agg(F.countDistinct("l_suppkey").alias("n"))
    return out.groupBy("tactic").agg(F.max("n").alias("peak"), F.sum("n").alias("total")).withColumn("rank", D.tactic_rank(F.col("tactic")))


def children_maps(spark, d):
    held = D.children_map(table(spark, d, "part"), "p_brand", "p_type", "p_name")
    return held.select("p_brand", F.explode("by_category").alias("p_type", "v")).select("p_brand", "p_type", F.array_join("v", ",").alias("names"))


def label_numbers(spark, d):
    return D.number_by_first(table(spark, d, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("label")), "label", "doc_id")


def address_cover(spark, d):
    """Customers and suppliers as addresses and published blocks, all within 10.0.0.0/8: numbers go on from its begin, and a span that would end behind it is none."""
    ip = lambda n: F.concat_ws(".", F.lit("10"), F.shiftright(n, 16).bitwiseAND(255), F.shiftright(n, 8).bitwiseAND(255), n.bitwiseAND(255))
    n = F.col("o_custkey") * 37
    points = table(spark, d, "orders").select("o_orderkey", ip(n).alias("address"))
    k = F.col("s_suppkey") * 701
    spans = table(spark, d, "supplier").select(F.when(F.col("s_nationkey") < 10, F.concat(ip(k - k % 256), F.lit("/24"))).when(F.col("s_nationkey") < 20, ip(k)).otherwise(F.concat(ip(k), F.lit("-"), ip(k + 999))).alias("entry"))
    ranges = spans.select(N.span(F.col("entry")).alias("s")).select("s.*")
    return N.covered(points, "address", ranges).select("o_orderkey", "covered")


def stix_export(spark, d):
    part = table(spark, d, "part")
    groups = part.groupBy(F.col("p_brand").alias("group_id")).agg(F.first("p_brand").alias("name"), F.concat(F.lit("crew of "), F.min("p_name")).alias("description"), F.array_sort(F.collect_set("p_type")).alias("aliases"))
    techniques = part.select(F.col("p_brand").alias("group_id"), F.concat(F.lit("T"), F.lpad(F.col("p_size").cast("string"), 4, "1"), F.lit(".001")).alias("technique_id"), F.concat(F.lit("Technique "), "p_size").alias("technique_name"))
    tools = part.select(F.col("p_brand").alias("group_id"), F.col("p_name").alias("tool_name"))
    return E.stix_objects(groups, techniques, tools, "2024-01-31 00:00:00").select("group_id", "id", "ordinal")


def stix_bundles(spark, d):
    part = table(spark, d, "part")
    groups = part.groupBy(F.col("p_brand").alias("group_id")).agg(F.first("p_brand").alias("name"), F.lit("").alias("description"), F.array_sort(F.collect_set("p_type")).alias("aliases"))
    none = part.where("false").select(F.col("p_brand").alias("group_id"), F.col("p_name").alias("technique_id"), F.col("p_name").alias("technique_name"))
    return E.stix_bundles(E.stix_objects(groups, none, part.select(F.col("p_brand").alias("group_id"), F.col("p_name").alias("tool_name")), "2024-01-31 00:00:00", "amber"))


def notification_events(spark, d):
    alerts = table(spark, d, "orders").select(F.col("o_orderkey").alias("alert_id"), F.col("o_custkey").alias("victim_id"), (F.col("o_custkey") % 40).alias("watch_id"))
    watch = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("watch_id"), F.col("n_name").alias("watch_name"))
    victims = table(spark, d, "customer").select(F.col("c_custkey").alias("victim_id"), F.col("c_name").alias("victim_name"), F.col("c_nationkey").cast("long").alias("group_id"))
    groups = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast("long").alias("group_id"), F.col("n_name").alias("group_name"))
    return E.events_of(alerts, watch, victims, groups).select("alert_id", "watch_name", "victim_name", F.coalesce("group_name", F.lit("")).alias("group_name"))


def notification_batches(spark, d):
    return E.event_batches(notification_events(spark, d), 2000, "alert_id").select("batch", F.length("payload").alias("chars"), F.size(F.split("payload", '"alert_id":')).alias("parts"))


def vector_cache(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    cache = docs.where("lang = 'fr'").select(F.lit("stub").alias("model"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), F.lit(None).cast("array<float>").alias("vector")).distinct()
    _, fresh = E.encode_missing(docs, "text", cache, "stub")
    return fresh.select("key", F.size("vector").alias("width"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"))


def prompt_prints(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", E.prompt_print(F.concat_ws("_", "role", F.lit("v1")), F.coalesce("text", F.lit(""))).alias("print"))


def country_flags(spark, d):
    code = F.concat(F.chr((F.col("n_nationkey") % 26 + 65).cast("long")), F.chr((F.col("n_nationkey") * 7 % 26 + 65).cast("long")))
    hinted = F.concat(F.lit("actors of "), F.element_at(F.array(*[F.lit(w) for w, _ in D.COUNTRIES]), (F.col("c_nationkey") % 22 + 1).cast("int")), F.lit(" and others"))
    flags = table(spark, d, "nation").select("n_nationkey", E.flag(code).alias("flag"))
    named = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).withColumn("country", F.coalesce(D.country_of(hinted), F.lit("")))
    return flags.join(named, F.col("n_nationkey") == F.col("c_nationkey")).select("n_nationkey", "flag", "country", "n")


QUERIES = {f.__name__: f for f in (
    designators, naming_schemes, identity_ladder, catalogue_keys, tactic_matrix, children_maps, label_numbers, address_cover, stix_export, stix_bundles, notification_events, notification_batches,
    vector_cache, prompt_prints, country_flags,
)}

_N = """n AS (SELECT p_partkey, CASE WHEN p_size < 10 THEN 'Storm-' || (p_partkey + 1000) WHEN p_size < 15 THEN 'UNC' || (p_partkey + 100) WHEN p_size < 20 THEN 'Fox TEMPEST'
WHEN p_size < 25 THEN 'Iron ' || string_split(p_name, ' ')[2] WHEN p_size < 35 THEN p_name || ' Group' ELSE p_name END AS name FROM part)"""
_DES = "CASE WHEN regexp_matches(lower(name), '^storm-\\d{3,5}$') THEN 'Microsoft' WHEN regexp_matches(lower(name), '^unc\\d{3,5}$') THEN 'Mandiant' ELSE '' END"
_EVENTS = """SELECT o_orderkey AS alert_id, w.n_name AS watch_name, c_name AS victim_name, coalesce(g.n_name, '') AS group_name FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation w ON w.n_nationkey = o_custkey % 40 LEFT JOIN nation g ON g.n_nationkey = c_nationkey AND g.n_regionkey < 3"""
_SHELL, _WRAP = '{"alert_id":,"watch_name":"","victim_name":"","group_name":""}', '{"events":[]}'
ORACLES = {
    "designators": f"WITH {_N} SELECT p_partkey, name, {_DES} AS authority FROM n",
    "naming_schemes": f"WITH {_N} SELECT p_partkey, CASE WHEN name = 'Fox TEMPEST' THEN 'Microsoft' ELSE 'Secureworks' END AS vendor, CASE WHEN name = 'Fox TEMPEST' THEN 'financially motivated' ELSE 'Russia' END AS encodes FROM n WHERE name = 'Fox TEMPEST' OR name LIKE 'Iron %'",
    "catalogue_keys": """WITH k AS (SELECT *, unnest([lower(p_name), replace(lower(p_name), ' ', '')]) AS key FROM part)
SELECT key, p_name AS canonical, p_brand AS authority FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY p_size % 3, p_partkey) = 1""",
    "tactic_matrix": f"""WITH l AS (SELECT [{", ".join(repr(t) for t in (*D.TACTICS, "Other"))}][l_linenumber % 15 + 1] AS tactic, l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1, 2)
SELECT tactic, max(n) AS peak, CAST(sum(n) AS BIGINT) AS total, CAST(list_position([{", ".join(repr(t) for t in (*D.TACTICS, "Other"))}], tactic) - 1 AS INTEGER) AS rank FROM l GROUP BY 1""",
    "children_maps": "SELECT p_brand, p_type, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS names FROM part GROUP BY 1, 2",
    "label_numbers": "WITH l AS (SELECT doc_id, lang || '/' || source AS label FROM documents), f AS (SELECT label, row_number() OVER (ORDER BY min(doc_id)) - 1 AS number FROM l GROUP BY label) SELECT doc_id, label, number FROM l JOIN f USING (label)",
    "address_cover": """WITH s AS (SELECT CASE WHEN s_nationkey < 10 THEN k - k % 256 ELSE k END % 16777216 AS lo, CASE WHEN s_nationkey < 10 THEN k - k % 256 + 255 WHEN s_nationkey < 20 THEN k ELSE k + 999 END % 16777216 AS hi FROM (SELECT s_nationkey, s_suppkey * 701 AS k FROM supplier))
SELECT o_orderkey, EXISTS (SELECT 1 FROM s WHERE (o_custkey * 37) % 16777216 BETWEEN lo AND hi) AS covered FROM orders""",
    "notification_events": _EVENTS,
    "notification_batches": f"SELECT alert_id // 2000 AS batch, CAST(sum(length(CAST(alert_id AS VARCHAR)) + length(watch_name) + length(victim_name) + length(group_name) + {len(_SHELL) + 1}) + {len(_WRAP) - 1} AS INTEGER) AS chars, CAST(count(*) + 1 AS INTEGER) AS parts FROM ({_EVENTS}) GROUP BY 1",
    "vector_cache": "SELECT DISTINCT sha256(coalesce(text, '')) AS key, 64 AS width, 1.0 AS norm FROM documents WHERE coalesce(text, '') NOT IN (SELECT coalesce(text, '') FROM documents WHERE lang = 'fr')",
    "prompt_prints": "SELECT conv_id, turn, role || '_v1+' || substring(sha256(coalesce(text, '')), 1, 8) AS print FROM conversations",
}
