"""Findings, scores, structures and increments on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderlake.functions import tables
from cinderlake.functions.indicators import anchor
from cinderlake.operators import contracts as C
from cinderlake.operators import extraction as X
from cinderlake.operators import guards as G
from cinderlake.operators import scoring as S
from cinderlake.operators import shapes as H
from cinderlake.session import shared_folder, table
from cinderlake.streaming import microbatch as B

EVENTS_AS_OF = "2024-01-31 00:00:00"


def ioc_scan(spark, d):
    return X.candidates(table(spark, d, "documents"), "doc_id", "text")


def grounded_vertices(spark, d):
    """Corners of an event's diamond, one per row, kept where their quotation stands in the whole article, parts in order."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" They used k"), "doc_id", F.lit(" tools, mostly at night.")).alias("text"))
    corners = {"adversary": "They used k{} tools", "capability": "used k{} ... at night", "infrastructure": "at night ... used k{}", "victim": "used k{}0 tools"}
    quotes = F.array(*[F.struct(F.lit(c).alias("vertex"), F.concat_ws("", F.lit(q.split("{}")[0]), "doc_id", F.lit(q.split("{}")[1])).alias("quote")) for c, q in corners.items()])
    rows = docs.select("doc_id", "text", F.inline(quotes))
    kept = X.ground(rows, "text", "quote").where("at.start IS NOT NULL")
    return kept.groupBy("vertex").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("articles"))


def indicator_rows(spark, d):
    """Of whole texts with a digest and a defanged host added: these, by a table function in SQL."""
    tables.register(spark)
    docs = table(spark, d, "documents")
    return spark.sql("""SELECT doc_id, kind, value, defanged FROM {docs} d, LATERAL indicators(concat(coalesce(d.text, ''), ' ', md5(concat('t', d.doc_id)), ' evil', d.doc_id % 50, '[.]example[.]org')) i
        WHERE kind = 'md5' OR value LIKE 'evil%.example.org'""", docs=docs)


def ioc_ipv4(spark, d):
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\b(?:\d{1,3}\.){3}\d{1,3}\b)"))
    return table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(found)).alias("value"))


def ioc_reconcile(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = X.candidates(docs, "doc_id", "text")
    real = found.select("doc_id", F.col("start").alias("seq"), "kind", F.replace("value", F.lit("."), F.lit("[.]")).alias("value"))
    again = real.withColumn("seq", F.col("seq") + 1_000_000)
    invented = docs.select("doc_id", F.lit(-1).alias("seq"), F.lit("ipv4").alias("kind"), F.lit("203.0.113.77").alias("value"))
    out = X.reconcile(real.unionByName(again).unionByName(invented), found, "doc_id")
    return out.groupBy("kind", "state").agg(F.count(F.lit(1)).alias("n"))


def quote_grounding(spark, d):
    """The third to sixth word of each document, looked up as a quotation."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.array_join(F.slice(F.split("text", r"\s+"), 3, 4), " ").alias("q"))
    at = docs.select("doc_id", anchor(F.col("text"), F.col("q"), True).alias("at"))
    return at.select("doc_id", F.col("at.start").alias("start"), F.col("at.end").alias("end"))


def ttp_ladder(spark, d):
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", F.concat_ws(" ", "p_name", "p_brand").alias("quote"))
    rows = lines.join(parts, "l_partkey").withColumn("seq", F.col("l_orderkey") * 100 + F.col("l_linenumber") + F.col("l_partkey") / 1e9)
    out = X.reconcile_capped(rows, "l_suppkey", "seq", "l_partkey", F.col("p_type") != "SMALL", F.col("quote"), F.col("l_returnflag") != "R")
    return out.groupBy("l_suppkey", "state").agg(F.count(F.lit(1)).alias("n"))


def claim_quality(spark, d):
    claims = table(spark, d, "conversations").select("conv_id", F.coalesce("text", F.lit("")).alias("claim"), (F.length("text") % 3).alias("label"))
    return X.distinct_claims(claims, "conv_id", "claim", F.col("label")).select("conv_id", "claims", F.round("share", 6).alias("share"), "quality")


def _scored(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")), "doc_id", "left")
    kind = F.element_at(F.array(*map(F.lit, S.FLOORS)), (F.coalesce("n_chars", F.lit(0)) % 5 + 1).cast("int"))
    critic = S.lookup(S.CRITIC, F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low"))
    raw = S.composite(
        {"anchor_ratio": S.anchor_ratio(F.length("source").cast("double"), F.coalesce("toxic", F.lit(0))), "critic_agreement": critic, "schema_completeness": S.completeness(F.col("lang"), F.col("source"), F.lit(None)), "self_assessed": (F.length("text") % 11) / 10.0},
        {"self_assessed": kind == "ioc", "schema_completeness": kind == "ttp"},
    )
    rows = docs.select("doc_id", "source", kind.alias("kind"), (F.col("lang") == "de").alias("local"), F.bround(raw, 6).alias("score_raw"), S.source_grade(F.element_at(F.array(*map(F.lit, "ABCDEF")), (F.length("text") % 6 + 1).cast("int"))).alias("sg"), S.info_grade(F.when(F.col("quality").isNotNull(), F.col("quality")), F.col("toxic") == 1, F.lit(True)).alias("ig"))
    for name, c in S.axes(F.col("score_raw"), F.col("sg"), F.col("ig")).items():
        rows = rows.withColumn(name, c)
    return S.decide(rows, "score_raw", "kind", "local")


def composite_gate(spark, d):
    return _scored(spark, d).select("doc_id", "kind", "score_raw", F.round("score_total", 6).alias("score_total"), "unjudgeable", "decision")


def gate_report(spark, d):
    g = _scored(spark, d)
    return g.groupBy("kind", "decision").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score_raw"), 4).alias("mean"))


def gate_reasons(spark, d):
    return _scored(spark, d).select("doc_id", "decision", "reason")


def spend_guard(spark, d):
    e = table(spark, d, "events")
    month, day = F.sum("value"), F.coalesce(F.sum(F.when(F.to_date("ts") == F.lit("2024-01-30").cast("date"), F.col("value"))), F.lit(0.0))
    spend = e.groupBy("event_type").agg(month.alias("month"), day.alias("day"))
    return spend.select("event_type", F.round("month", 2).alias("month"), F.round("day", 2).alias("day"), S.budget(F.col("month"), F.col("day"), 100_000.0, 10_000.0).alias("verdict"))


def tlp_levels(spark, d):
    docs = table(spark, d, "documents").select("source", F.element_at(F.array(*map(F.lit, ["clear", "GREEN", "amber", "unknown", "red"])), (F.col("n_chars") % 5 + 1).cast("int")).alias("tlp"))
    return S.most_restrictive(docs.where("tlp <> 'red'"), ["source"], "tlp")


def routing(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.coalesce("n_chars", F.lit(0)).alias("n"))
    tlp = F.element_at(F.array(*map(F.lit, S.TLP)), (F.col("n") % 5 + 1).cast("int"))
    choice = S.route(F.col("n"), 20_000, tlp, F.col("lang") == "fr", F.col("source") == "src3", F.when(F.col("n") % 2 == 0, "degrade").otherwise("allow"), [("mini", "small"), ("maxi", "large")])
    return docs.select(choice.alias("choice")).groupBy("choice").agg(F.count(F.lit(1)).alias("n"))


def age_bands(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.select("user_id", S.age_status(F.col("last"), EVENTS_AS_OF, 1.0, 2.0).alias("status"))


def revert_audit(spark, d):
    return S.revert(table(spark, d, "events"), "user_id", "event_type", "value", "event_id")


def fingerprint_props(spark, d):
    return C.dataset_structure(table(spark, d, "events"), ["event_type"], "props", "event_id").select("event_type", "structure", "n")


def merged_shapes(spark, d):
    """Nodes of the merged structure of nested payloads by priority: free keys become a map, optional ones stay."""
    o = table(spark, d, "orders")
    item = F.struct(F.col("o_orderstatus").alias("s"), F.when(F.col("o_orderkey") % 2 == 0, 1).alias("v"))
    body = F.struct(F.col("o_orderkey").alias("id"), F.create_map(F.concat(F.lit("c"), "o_orderkey"), F.struct(F.col("o_totalprice").alias("p"))).alias("by"), F.array(item).alias("tags"), F.when(F.col("o_custkey") % 2 == 0, F.lit("x")).otherwise(F.lit("")).alias("note"))
    shapes = H.shape_rows(o.select("o_orderpriority", F.to_json(body).alias("body")), ["o_orderpriority"], "body")
    return shapes.select("o_orderpriority", H.path_text(F.col("path")).alias("path"), "kind", "n")


def structure_checks(spark, d):
    """Samples of the second half of a month against what the first half's structures are stored as; views have none stored."""
    e = table(spark, d, "events")
    late = F.col("ts") >= "2024-01-16"
    props = F.when(late & (F.col("event_type") == "click"), F.replace("props", F.lit('"k"'), F.lit('"q"'))).when(late & (F.col("event_type") == "error"), F.regexp_replace("props", r": (\d+)", r': "$1"')).otherwise(F.col("props"))
    shapes = lambda rows: H.shape_texts(H.shape_rows(rows.withColumn("props", props), ["event_type"], "props"), ["event_type"])
    stored = G.load_baseline(spark, G.save_baseline(shapes(e.where(~late & (F.col("event_type") != "view"))), "event_type", "structure"))
    found = H.check(shapes(e.where(late)), stored.withColumnRenamed("name", "event_type"), "event_type", "structure")
    return found.select("event_type", "status", F.array_join("problems", ",").alias("problems"))


def structure_health(spark, d):
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return C.health(counts, "n", 2000, 1000)


def microbatch_alerts(spark, d):
    """Large errors found batch by batch from the events' files, the same rows as in one pass."""
    events = table(spark, d, "events")
    out = shared_folder(spark, "alerts")
    stream = B.read_increments(spark, f"{d}/events.parquet*", events.schema)
    match = lambda rows: rows.where("event_type = 'error' AND value > 100").select("event_id", "user_id")
    B.run_available(stream, shared_folder(spark, "alerts-checkpoint"), B.append_matches(out, match, ["event_id"]))
    return spark.read.parquet(out).select("event_id", "user_id")


def backfill_years(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'P' AND month(o_orderdate) <= 6").select(F.concat(F.lit("orders:"), F.year("o_orderdate")).alias("key")).distinct()
    return B.missing_years(done, spark, "orders", 1990, 2005)


QUERIES = {f.__name__: f for f in (
    ioc_scan, ioc_ipv4, ioc_reconcile, quote_grounding, ttp_ladder, claim_quality, composite_gate, gate_report, gate_reasons, spend_guard, tlp_levels, routing, age_bands, revert_audit,
    grounded_vertices, indicator_rows, fingerprint_props, merged_shapes, structure_checks, structure_health, microbatch_alerts, backfill_years,
)}

_L = "(SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1)"
_GATE = f"""s AS (SELECT d.doc_id, lang = 'de' AS local, ['ioc', 'ttp', 'narrative', 'sketch', 'diamond'][n_chars % 5 + 1] AS kind, length(text) AS len, quality, toxic, length(source) / (length(source) + coalesce(toxic, 0)) AS ar,
coalesce(CASE quality WHEN 1 THEN 1.0 WHEN 0 THEN 0.2 END, 0.5) AS ca, (CASE WHEN lang <> '' THEN 1 ELSE 0 END + CASE WHEN source <> '' THEN 1 ELSE 0 END) / 3.0 AS sc, coalesce((length(text) % 11) / 10.0, 0.5) AS sa FROM documents d LEFT JOIN {_L} l USING (doc_id)),
r AS (SELECT *, round_even(CASE kind WHEN 'ioc' THEN (ar * 0.4 + ca * 0.3 + sc * 0.2) / 0.9 WHEN 'ttp' THEN (ar * 0.4 + ca * 0.3 + sa * 0.1) / 0.8 ELSE ar * 0.4 + ca * 0.3 + sc * 0.2 + sa * 0.1 END, 6) AS score_raw,
[1.0, 0.9, 0.75, 0.55, 0.3, NULL][len % 6 + 1] AS f1, CASE WHEN quality IS NULL THEN NULL WHEN toxic = 1 THEN 0.2 WHEN quality >= 1 THEN 1.0 ELSE 0.75 END AS f2,
least(1.0, CASE kind WHEN 'ioc' THEN 0.85 WHEN 'ttp' THEN 0.7 WHEN 'narrative' THEN 0.9 ELSE 0.75 END + CASE WHEN local THEN 0.1 ELSE 0 END) AS own, 0.75 + CASE WHEN local THEN 0.1 ELSE 0 END AS overall FROM s),
g AS (SELECT *, f1 IS NULL OR f2 IS NULL AS unjudgeable, score_raw * coalesce(f1, 1) * coalesce(f2, 1) AS score_total, CASE WHEN f1 IS NOT NULL AND f2 IS NOT NULL AND score_raw >= own AND score_raw >= overall THEN 'auto' ELSE 'staged' END AS decision FROM r)"""

ORACLES = {
    "ioc_ipv4": r"SELECT doc_id, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '\b(?:\d{1,3}\.){3}\d{1,3}\b'))) AS value FROM documents",
    "ttp_ladder": """WITH r AS (SELECT l_suppkey, l_orderkey * 100 + l_linenumber + l_partkey / 1e9 AS seq, l_partkey, p_type <> 'SMALL' AS known, length(p_name || ' ' || p_brand) AS len, l_returnflag <> 'R' AS anch FROM lineitem JOIN part ON l_partkey = p_partkey),
f AS (SELECT *, known AND len >= 16 AND anch AS good, row_number() OVER (PARTITION BY l_suppkey, l_partkey, known AND len >= 16 AND anch ORDER BY seq) = 1 AS first FROM r),
b AS (SELECT *, coalesce(sum(CASE WHEN good AND first THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
SELECT l_suppkey, CASE WHEN before >= 10 THEN 'cap' WHEN NOT known THEN 'unknown' WHEN len < 16 THEN 'weak' WHEN NOT anch THEN 'unanchored' WHEN NOT first THEN 'duplicate' ELSE 'kept' END AS state, count(*) AS n FROM b GROUP BY 1, 2""",
    "claim_quality": r"""WITH c AS (SELECT conv_id, regexp_replace(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))), '[.;:!? ]+$', '') AS c, max(length(text) % 3) AS worst FROM conversations GROUP BY 1, 2),
q AS (SELECT conv_id, count(*) AS claims, avg(CASE WHEN worst = 0 THEN 1.0 ELSE 0.0 END) AS share FROM c GROUP BY 1)
SELECT conv_id, claims, round(share, 6) AS share, CASE WHEN share > 0.8 THEN 'high' WHEN share >= 0.5 THEN 'moderate' ELSE 'low' END AS quality FROM q""",
    "composite_gate": f"WITH {_GATE} SELECT doc_id, kind, score_raw, round(score_total, 6) AS score_total, unjudgeable, decision FROM g",
    "gate_report": f"WITH {_GATE} SELECT kind, decision, count(*) AS n, round(avg(score_raw), 4) AS mean FROM g GROUP BY 1, 2",
    "gate_reasons": f"""WITH {_GATE} SELECT doc_id, decision, CASE WHEN unjudgeable THEN CASE WHEN f1 IS NULL AND f2 IS NULL THEN 'neither source nor information' WHEN f1 IS NULL THEN 'source' ELSE 'information' END || ' has no grade'
WHEN score_raw < own THEN printf('%.6f', score_raw) || ' is below the floor of ' || kind WHEN score_raw < overall THEN printf('%.6f', score_raw) || ' is below the floor over all' ELSE printf('%.6f', score_raw) || ' passes' END AS reason FROM g""",
    "spend_guard": """WITH s AS (SELECT event_type, sum(value) AS month, coalesce(sum(value) FILTER (CAST(ts AS DATE) = DATE '2024-01-30'), 0) AS day FROM events GROUP BY 1)
SELECT event_type, round(month, 2) AS month, round(day, 2) AS day, CASE WHEN month >= 100000 OR day >= 10000 THEN 'refuse' WHEN month >= 80000 THEN 'degrade' ELSE 'allow' END AS verdict FROM s""",
    "tlp_levels": """SELECT source, ['clear', 'green', 'amber', 'amber+strict', 'red'][max([0, 1, 2, 3, 4][n_chars % 5 + 1]) + 1] AS tlp FROM documents WHERE n_chars % 5 <> 4 GROUP BY source""",
    "routing": """WITH d AS (SELECT lang, source, coalesce(n_chars, 0) AS n FROM documents) SELECT CASE WHEN n > 20000 THEN 'refused:size' WHEN source = 'src3' THEN 'refused:source' WHEN NOT (n % 5 <= 1 OR lang = 'fr') THEN 'refused:tlp'
WHEN n % 2 = 0 THEN 'mini' ELSE 'maxi' END AS choice, count(*) AS n FROM d GROUP BY 1""",
    "age_bands": """WITH l AS (SELECT user_id, epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts)) AS age FROM events GROUP BY 1) SELECT user_id, CASE WHEN age < 86400000000 THEN 'ok' WHEN age < 172800000000 THEN 'degraded' ELSE 'down' END AS status FROM l""",
    "revert_audit": "SELECT user_id, event_type, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2",
    "fingerprint_props": r"""SELECT event_type, '{' || string_agg(DISTINCT '"' || k || '": "number"', ', ') || '}' AS structure, count(*) AS n FROM (SELECT event_type, unnest(regexp_extract_all(props, '"(\w+)":', 1)) AS k FROM events) GROUP BY event_type""",
    "grounded_vertices": "SELECT v AS vertex, count(*) AS n, count(DISTINCT doc_id) AS articles FROM documents, (SELECT unnest(['adversary', 'capability']) AS v) GROUP BY 1",
    "indicator_rows": """SELECT doc_id, 'md5' AS kind, md5('t' || doc_id) AS value, false AS defanged FROM documents
UNION ALL SELECT doc_id, 'domain', 'evil' || doc_id % 50 || '.example.org', true FROM documents
UNION SELECT doc_id, 'md5', unnest(regexp_extract_all(lower(text), '(?:^|[^0-9a-z])([0-9a-f]{32})(?:$|[^0-9a-z])', 1)), false FROM documents""",
    "merged_shapes": """WITH o AS (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderkey % 2 = 0) AS even, count(*) FILTER (o_custkey % 2 = 0) AS noted FROM orders GROUP BY 1),
k AS (SELECT unnest(['$', '$.id', '$.by', '$.by.*', '$.by.*.p', '$.note', '$.tags', '$.tags[]', '$.tags[].s', '$.tags[].v']) AS path, unnest(['dict', 'number', 'dict', 'dict', 'number', 'str', 'list', 'dict', 'str', 'number']) AS kind)
SELECT o_orderpriority, path, kind, CAST(CASE path WHEN '$.tags[].v' THEN even ELSE n END AS BIGINT) AS n FROM o, k WHERE even > 0 OR path <> '$.tags[].v'""",
    "structure_checks": """SELECT event_type, CASE event_type WHEN 'view' THEN 'no-baseline' WHEN 'click' THEN 'drift' WHEN 'error' THEN 'drift' ELSE 'alive+match' END AS status,
CASE event_type WHEN 'click' THEN '$.k removed,$.q added' WHEN 'error' THEN '$.k changed' ELSE '' END AS problems FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1""",
    "structure_health": "SELECT event_type, count(*) AS n, CASE WHEN count(*) >= 2000 THEN 'ok' WHEN count(*) >= 1000 THEN 'degraded' ELSE 'down' END AS status FROM events GROUP BY 1",
    "microbatch_alerts": "SELECT event_id, user_id FROM events WHERE event_type = 'error' AND value > 100",
    "backfill_years": "SELECT CAST(y AS INTEGER) AS year FROM range(1990, 2006) t(y) WHERE y NOT IN (SELECT year(o_orderdate) FROM orders WHERE o_orderstatus = 'P' AND month(o_orderdate) <= 6)",
}
