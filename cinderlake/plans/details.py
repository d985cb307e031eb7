"""Updates and small text and JSON functions on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderlake.functions import text as T
from cinderlake.operators import updates as U
from cinderlake.session import shared_folder, table
from cinderlake.streaming import attempts as L
from cinderlake.streaming import microbatch as B
from cinderlake.streaming import outbox as O

EVENTS_AS_OF = "2024-01-31 00:00:00"


def alerts_marked(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", (F.col("value") > 50).alias("seen"))
    return U.mark(e, "seen", F.col("user_id").isin(1, 2, 3))


def alerts_actioned(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("value") > 50).alias("seen"), F.when(F.col("event_type") == "view", F.col("ts")).alias("actioned_at"))
    out = U.act(e, F.col("event_id") >= 100, EVENTS_AS_OF)
    return out.select("event_id", "seen", F.coalesce(F.date_format("actioned_at", "yyyy-MM-dd"), F.lit("")).alias("day"))


def control_flags(spark, d):
    control = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("number"))
    return U.enabled(control, table(spark, d, "documents"), "doc_id", "number")


def clipped_rows(spark, d):
    return U.clipped(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), {"role": 4, "text": 80})


def aliases_appended(spark, d):
    part = table(spark, d, "part")
    current = part.where("p_size < 20").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("aliases"))
    new = part.where("p_size >= 20").groupBy("p_brand", F.split("p_name", " ")[1].alias("value")).agg(F.countDistinct("p_type").cast("int").alias("sources"))
    out, audit = U.append_values(current, new, "p_brand", "aliases", "sources", 2, ["Ring"])
    back = U.reverted(out.select("p_brand", F.col("aliases").alias("again")), audit.withColumn("n", F.lit(1)), "p_brand", "again", "n")
    return out.join(back, "p_brand").select("p_brand", F.array_join("aliases", ",").alias("aliases"), F.array_join("again", ",").alias("reverted"))


def login_backoff(spark, d):
    errors = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failures"))
    return errors.select("user_id", "failures", U.backoff(F.col("failures")).alias("wait"))


def _login_attempts(rows):
    return L.prepared(rows, F.col("user_id"), F.col("ts"), F.col("event_type") == "error", F.col("event_type") == "purchase", F.col("event_id"))


def login_locks(spark, d):
    """Locks after each attempt of a user: errors fail, purchases succeed."""
    return _columns(L.locks_in_batch(_login_attempts(table(spark, d, "events"))))


def login_lock_stream(spark, d):
    """The same from a stream of the events' files, as its sink holds it in the end."""
    stream = L.locks(_login_attempts(B.read_increments(spark, f"{d}/events.parquet*", table(spark, d, "events").schema)), "1 hour")
    out = shared_folder(spark, "locks")
    with L.state_store(spark):
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_folder(spark, "locks-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return _columns(spark.read.parquet(out).where("what = 'attempt'"))


def _columns(locks):
    seconds = (F.unix_micros("until") - F.unix_micros("at")) / 1_000_000
    return locks.select("key", F.col("ord").alias("event_id"), "fails", F.coalesce(seconds.cast("int"), F.lit(0)).alias("locked"))


def notification_outbox(spark, d):
    """Alerts for errors out of a stream of the events' files, as the committed files of the outbox hold them."""
    stream = B.read_increments(spark, f"{d}/events.parquet*", table(spark, d, "events").schema).where("event_type = 'error'")
    path = shared_folder(spark, "outbox")
    alerts = stream.select(F.col("event_id").alias("alert_id"), F.concat(F.lit("user "), "user_id").alias("title"), F.col("ts").cast("timestamp").alias("at"))
    O.send(alerts, path, shared_folder(spark, "outbox-checkpoint"), 50).awaitTermination()
    return O.events(spark, path, "alert_id long, title string, at timestamp").select("alert_id", "title", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


def refanged_urls(spark, d):
    """Addresses of pages written so that nobody follows them by mistake, and back."""
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^http", "hxxp"), "://", "[:]//"), r"\.", F.lit("[.]"))
    url = F.when(F.col("page_id") % 3 == 0, F.regexp_replace(url, r"\[\.\]", " ( DOT ) ")).otherwise(url)
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace(url, r" (\( DOT \)) ", "$1").alias("u"))
    return pages.select("page_id", T.refang(F.concat(F.lit("\u200b"), "u")).alias("url"))


def described_victims(spark, d):
    """Paragraphs of a description, the addresses of its source lines, and links that are safe to show."""
    text = F.concat(F.lit("First line<br>of  page "), "page_id", F.lit("<BR/>\n\nSource: "), "url", F.lit("\n  source: none\n\n\n last\twords "))
    link = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("javascript:"), "url")).when(F.col("page_id") % 4 == 1, F.upper("url")).otherwise(F.concat(F.lit(" "), "url"))
    pages = table(spark, d, "pages").select("page_id", text.alias("t"), link.alias("link"))
    return pages.select("page_id", F.array_join(T.paragraphs(F.col("t")), "|").alias("paragraphs"), F.array_join(T.source_urls(F.col("t")), "|").alias("sources"), T.safe_url(F.col("link")).alias("link"))


def parsed_times(spark, d):
    """Times in the forms in which feeds write them, and some that are none."""
    ts = F.col("ts").cast("timestamp")
    at = lambda form: F.date_format(ts, form)
    forms = (at("yyyy-MM-dd'T'HH:mm:ss'Z'"), F.concat(at("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")), at("yyyy-MM-dd HH:mm:ss"), at("yyyy-MM-dd"), F.lit("soon"))
    text = F.get(F.array(*forms), (F.col("event_id") % len(forms)).cast("int"))
    return table(spark, d, "events").select("event_id", F.coalesce(F.date_format(T.timestamp(text), "yyyy-MM-dd HH:mm:ss"), F.lit("none")).alias("at"))


def feed_tally(spark, d):
    n = F.coalesce(F.length("text"), F.lit(0))
    out = U.feed_tally(table(spark, d, "documents"), "source", n > 500, n > 100, n)
    return out.withColumn("mean_chars", F.round("mean_chars", 4))


def longest_text(spark, d):
    docs = table(spark, d, "documents").groupBy("source").agg(F.min_by("text", "doc_id").alias("old"), F.max_by("text", "doc_id").alias("new"))
    return docs.select("source", F.sha2(T.longer(F.col("old"), F.col("new")), 256).alias("kept"))


def neutral_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.neutralised(F.coalesce("html", F.lit("")), ["article", "nav", "script"])).alias("h"))


def link_targets(spark, d):
    cell = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("["), "page_id", F.lit("]("), "url", F.lit(")"))).when(F.col("page_id") % 3 == 1, F.col("url")).otherwise("none")
    return table(spark, d, "pages").select("page_id", F.coalesce(T.link_target(cell), F.lit("")).alias("target"))


def tolerant_json(spark, d):
    k = F.get_json_object("props", "$.k")
    shape = F.when(F.col("event_type") == "view", F.concat(F.lit("["), k, F.lit(","), k, F.lit("]"))).when(F.col("event_type") == "click", k).when(F.col("event_type") == "error", F.lit("not json")).otherwise(F.col("props"))
    e = table(spark, d, "events").select("event_id", shape.alias("x"))
    return e.select("event_id", F.coalesce(T.count_of(F.col("x")), F.lit(-1)).alias("n"), T.type_label(F.col("x")).alias("label"), F.array_join(T.tolerant_list(F.col("x")), ",").alias("list"), F.coalesce(T.lenient_json(F.concat(F.lit("```json\n"), "x", F.lit("\n```"))), F.lit("")).alias("object"))


def context_windows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.floor(F.length("text") / 2).cast("int").alias("at"))
    return docs.select("doc_id", T.window_around(F.col("text"), F.col("at"), F.least(F.col("at") + 10, F.length("text")), 40).alias("w"))


QUERIES = {f.__name__: f for f in (
    alerts_marked, alerts_actioned, control_flags, clipped_rows, aliases_appended, login_backoff, login_locks, login_lock_stream, notification_outbox, refanged_urls, described_victims, parsed_times, feed_tally, longest_text, neutral_text, link_targets, tolerant_json, context_windows,
)}

_X = "CASE event_type WHEN 'view' THEN '[' || k || ',' || k || ']' WHEN 'click' THEN k WHEN 'error' THEN 'not json' ELSE props END"
_LOCKS = """WITH a AS (SELECT user_id, event_id, ts, event_type = 'error' AS failed, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events WHERE event_type IN ('error', 'purchase')),
f AS (SELECT user_id, event_id, failed, count(*) FILTER (failed) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS fails FROM a)
SELECT CAST(user_id AS VARCHAR) AS key, event_id, CAST(fails AS INTEGER) AS fails, CAST(CASE WHEN failed AND fails >= 5 THEN least(900, 30 * pow(2, least(fails - 5, 20))) ELSE 0 END AS INTEGER) AS locked FROM f"""
ORACLES = {
    "alerts_marked": "SELECT event_id, user_id, value > 50 OR user_id IN (1, 2, 3) AS seen FROM events",
    "alerts_actioned": """WITH e AS (SELECT event_id, value > 50 AS seen, CASE WHEN event_id >= 100 THEN CASE WHEN event_type <> 'view' THEN TIMESTAMP '2024-01-31' END WHEN event_type = 'view' THEN ts END AS a FROM events)
SELECT event_id, seen OR a IS NOT NULL AS seen, coalesce(strftime(a, '%Y-%m-%d'), '') AS day FROM e""",
    "control_flags": "SELECT doc_id, coalesce(n, 1) = 1 AS enabled FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS n FROM labels GROUP BY 1) USING (doc_id)",
    "clipped_rows": "SELECT conv_id, turn, substring(role, 1, 4) AS role, substring(text, 1, 80) AS text FROM conversations",
    "aliases_appended": """WITH c AS (SELECT p_brand, list_sort(list(DISTINCT p_type)) AS a FROM part WHERE p_size < 20 GROUP BY 1),
n AS (SELECT p_brand, string_split(p_name, ' ')[2] AS v FROM part WHERE p_size >= 20 GROUP BY 1, 2 HAVING count(DISTINCT p_type) >= 2), g AS (SELECT p_brand, list_sort(list(v)) AS b FROM n WHERE lower(v) <> 'ring' GROUP BY 1)
SELECT p_brand, array_to_string(list_concat(a, list_filter(coalesce(b, []), lambda x: NOT list_contains(a, x))), ',') AS aliases, array_to_string(a, ',') AS reverted FROM c LEFT JOIN g USING (p_brand)""",
    "login_backoff": "WITH e AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1) SELECT user_id, failures, CAST(CASE WHEN failures < 5 THEN 0 ELSE least(900, 30 * pow(2, least(failures - 5, 20))) END AS INTEGER) AS wait FROM e",
    "login_locks": _LOCKS,
    "login_lock_stream": _LOCKS,
    "refanged_urls": "SELECT page_id, url FROM pages",
    "described_victims": """SELECT page_id, 'First line of page ' || page_id || '|last words' AS paragraphs, url AS sources,
CASE page_id % 4 WHEN 0 THEN '#' WHEN 1 THEN upper(url) ELSE url END AS link FROM pages""",
    "parsed_times": "SELECT event_id, CASE event_id % 5 WHEN 4 THEN 'none' WHEN 3 THEN strftime(ts, '%Y-%m-%d 00:00:00') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at FROM events",
    "notification_outbox": "SELECT event_id AS alert_id, 'user ' || user_id AS title, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE event_type = 'error'",
    "feed_tally": """SELECT source, count(*) FILTER (n > 500) AS ok, count(*) FILTER (n <= 100) AS refused, count(*) FILTER (n > 100 AND n <= 500) AS deferred, round(avg(n) FILTER (n > 500), 4) AS mean_chars FROM (SELECT source, coalesce(length(text), 0) AS n FROM documents) GROUP BY 1""",
    "longest_text": "WITH s AS (SELECT source, arg_min(text, doc_id) AS o, arg_max(text, doc_id) AS n FROM documents GROUP BY 1) SELECT source, sha256(CASE WHEN length(n) > length(o) THEN n ELSE o END) AS kept FROM s",
    "link_targets": "SELECT page_id, CASE WHEN page_id % 3 = 2 THEN '' ELSE url END AS target FROM pages",
    "tolerant_json": f"""WITH e AS (SELECT event_id, event_type, k, {_X} AS x FROM (SELECT *, regexp_extract(props, '(\\d+)', 1) AS k FROM events))
SELECT event_id, CAST(CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN CAST(k AS INTEGER) ELSE -1 END AS INTEGER) AS n, CASE WHEN event_type IN ('signup', 'purchase') THEN 'k' WHEN event_type = 'view' THEN x ELSE x END AS label,
CASE event_type WHEN 'view' THEN k || ',' || k WHEN 'click' THEN k ELSE '' END AS list, CASE WHEN event_type IN ('signup', 'purchase') THEN x ELSE '' END AS object FROM e""",
}
