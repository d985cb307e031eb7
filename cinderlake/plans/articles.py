"""States, style, actors, infrastructure, reports and guards on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderlake.functions import tables
from cinderlake.operators import articles as A
from cinderlake.operators import guards as G
from cinderlake.operators import style as S
from cinderlake.session import table

#: What the synthetic articles say besides their own prose, one phrase an article, so that every rule has something to find.
PHRASES = (
    "The group uses various tools, etc.", "It remains to be seen — a very unique case.", "Available evidence suggests that it could spread.", "If patched, it may stop.", "Defenders are advised to patch and should act.",
    "The article provides guidance and more.", "This was decimated; it might return.", "A plain ending.",
)
WIDTH = 16


def _pick(values, c):
    return F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))


def _prose(spark, d):
    docs = table(spark, d, "documents")
    opener = F.when(F.col("doc_id") % 5 == 0, "First observed in May. ").otherwise("")
    return docs.select("doc_id", "source", "lang", F.concat(opener, F.coalesce("text", F.lit("")), F.lit(". "), _pick(PHRASES, F.col("doc_id"))).alias("prose"))


def style_breaches(spark, d):
    return S.checked(_prose(spark, d), ["doc_id"], "prose", advice_allowed=False).select("doc_id", "nth", "rule", "text", "start", "end")


def style_report(spark, d):
    """Breaches per rule and language, as runs of two prompt versions (by source)."""
    rows = _prose(spark, d)
    return S.tally(S.checked(rows, ["doc_id", "source", "lang"], "prose", advice_allowed=False), ["source", "lang"])


def style_clean(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", _pick(PHRASES, F.col("doc_id")).alias("prose"))
    return S.clean_share(rows, S.checked(rows, ["doc_id", "source"], "prose", advice_allowed=False), ["doc_id", "source"], ["source"]).withColumn("share", F.round("share", 6))


def style_rows(spark, d):
    """Breaches by a table function in SQL, row by row."""
    tables.register(spark)
    rows = table(spark, d, "documents").select("doc_id", "source", _pick(PHRASES, F.col("doc_id")).alias("prose"))
    return spark.sql("SELECT source, count(*) AS breaches, count(DISTINCT doc_id) AS texts FROM {rows} r, LATERAL breaches(r.prose, false) b GROUP BY source", rows=rows)


def style_worst(spark, d):
    return S.worst(S.checked(_prose(spark, d), ["doc_id", "source"], "prose", advice_allowed=False), ["doc_id"], ["source"], 3)


def _runs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.array(*map(F.lit, A.STATES))).alias("i", "state")).where("i < doc_id % 9")
    odd = _pick(("staged", "error", "dropped", "month cap"), F.col("doc_id"))
    return docs.withColumn("status", F.when((F.col("doc_id") + 3 * F.col("i")) % 11 == 0, odd).otherwise("ok"))


def article_progress(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 13 != 0, F.col("text")).alias("body"))
    return A.progress(docs, "doc_id", "body", _runs(spark, d))


def attempt_ladder(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", _pick(("failed", "rejected", "answered", "failed", "refused", "rejected", "irrelevant", "unwired"), F.floor("value").cast("long")).alias("outcome"))
    return A.attempt_status(e.withColumn("detail", F.concat(F.lit("d"), F.col("event_id") % 3)), ["user_id", "event_type"], "event_id")


def ingest_phases(spark, d):
    host = lambda c: F.concat(F.lit("feed"), c % 20)
    seeds = table(spark, d, "nation").select(F.concat(F.lit("feed"), "n_nationkey").alias("source"), F.lit(True).alias("enabled"))
    sources = table(spark, d, "region").select(F.concat(F.lit("feed"), F.col("r_regionkey") * 2).alias("source"), (F.col("r_regionkey") % 2 == 0).alias("enabled"))
    pages = table(spark, d, "pages")
    entries = pages.select("url", host(F.col("page_id")).alias("source"))
    held = pages.where("page_id % 3 = 0").groupBy("url").agg(F.min("page_id").alias("p")).select("url", host(F.col("p")).alias("source"), F.when(F.col("p") % 2 == 0, F.lit("body")).alias("body"))
    a, b, c = A.ingest_cycle(seeds, sources, entries, held)
    count = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("phase"), "n")
    return count(a, "sources").unionByName(count(b, "articles")).unionByName(count(c, "queue"))


def _outputs(spark, d):
    words = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r'["\\]', " "), r"\s+")
    actor = lambda **kw: F.struct(*[v.alias(k) for k, v in kw.items()])
    quote = F.when(F.col("doc_id") % 2 == 0, F.array_join(F.slice(words, 3, 4), " ")).otherwise("words that no article has")
    objects = F.to_json(F.array(
        actor(name=F.get(words, F.lit(1)), relation=F.lit(A.SAME_ACTOR), related_to=F.lit("widget"), evidence_quote=quote), actor(name=F.lit("Nobody Of Note"), relation=F.lit("affiliate_of"), related_to=F.lit("x"), evidence_quote=F.lit("")),
    ))
    plain = F.to_json(F.array(F.get(words, F.lit(0)), F.lit("")))
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "text", F.concat(F.lit('{"named_actors": '), F.when(F.col("doc_id") % 3 == 0, plain).otherwise(objects), F.lit("}")).alias("output"))


def named_actors(spark, d):
    a = _outputs(spark, d).select("doc_id", F.posexplode(A.actors_of(F.col("output"))).alias("nth", "a"))
    return a.groupBy("a.relation", "a.related_to").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


def grounded_actors(spark, d):
    return A.ground_actors(_outputs(spark, d), "doc_id", "text", "output").select("doc_id", "nth", "name", "state", "claimed", "relation")


def projected_columns(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lit("old").alias("article_type"), F.col("lang").alias("summary_md"), F.col("source").alias("recommendations_md"))
    json_ = F.to_json(F.struct(F.concat(F.lit("kind"), F.col("doc_id") % 4).alias("article_type"), F.concat(F.lit("sum "), "lang").alias("summary_md"), F.when(F.col("doc_id") % 2 == 0, "").otherwise("act").alias("recommendations_md")))
    outputs = table(spark, d, "documents").select("doc_id", json_.alias("output"))
    runs = outputs.select("doc_id", F.explode(F.array(F.lit("classify"), F.lit("narrative"), F.lit("verify"))).alias("state"), "output").where("NOT (state = 'classify' AND doc_id % 3 = 0) AND NOT (state = 'narrative' AND doc_id % 5 = 0)")
    out = A.projected(docs, "doc_id", runs)
    return out.select("doc_id", "article_type", "summary_md", F.coalesce("recommendations_md", F.lit("none")).alias("recommendations_md"))


def _findings(spark, d):
    o = table(spark, d, "orders")
    value = F.when(F.col("o_custkey") % 4 == 0, F.concat(F.lit("wallet"), F.col("o_custkey") % 90)).otherwise(F.concat(F.lit("http://host"), F.col("o_custkey") % 60, F.lit(".onion/")))
    kind = F.when(F.col("o_custkey") % 4 == 0, "btc_address").when(F.col("o_custkey") % 4 == 1, "url").otherwise("sha256")
    return o.select(
        F.col("o_orderkey").alias("article_id"), F.when(F.col("o_orderkey") % 5 < 4, "ioc").otherwise("ttp").alias("finding_kind"), F.when(F.col("o_orderstatus") == "F", "auto").otherwise("staged").alias("decision"),
        F.to_json(F.struct(kind.alias("ioc_type"), value.alias("value"))).alias("payload"), (F.col("o_custkey") % 30).alias("target"),
    )


def promoted_infrastructure(spark, d):
    excluded = table(spark, d, "supplier").select(F.concat(F.lit("host"), F.col("s_suppkey") % 25, F.lit(".onion")).alias("key"))
    from cinderlake.functions.text import host

    out = A.promoted(_findings(spark, d), "article_id", excluded, F.coalesce(host(F.col("value")), F.col("value")))
    return out.select("article_id", "field", F.array_join("values", ",").alias("values"))


def payload_corroboration(spark, d):
    articles = table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("source"))
    return A.payload_sources(_findings(spark, d), articles, "article_id", "source")


def synonym_pairs(spark, d):
    part = table(spark, d, "part")
    actors = part.select(F.concat_ws(" ", "p_name", (F.col("p_partkey") % 3).cast("string")).alias("name"), F.when(F.col("p_size") % 2 == 0, A.SAME_ACTOR).otherwise("operator_of").alias("relation"), F.upper("p_name").alias("related_to"))
    known = part.select(F.lower("p_name").alias("key"), F.col("p_name").alias("target")).unionByName(part.where("p_partkey % 3 = 0 AND p_size > 25").select(F.concat_ws(" ", "p_name", F.lit("0")).alias("key"), F.col("p_name").alias("target")))
    return A.synonyms(actors, known)


def _regraded(spark, d):
    sources = table(spark, d, "supplier").select(F.col("s_name").alias("name"), _pick("ABCDEF", F.col("s_suppkey")).alias("grade"))
    grades = table(spark, d, "supplier").where("s_nationkey < 12").select(F.col("s_name").alias("name"), _pick("AABC", F.col("s_suppkey")).alias("grade"), F.lit("analyst").alias("by"))
    return A.regraded(sources, grades, "name", F.lit("2024-01-31"))


def regrade_audit(spark, d):
    return _regraded(spark, d)[1]


def source_grades(spark, d):
    """The grades that stand after the change that :func:`regrade_audit` tells of."""
    return _regraded(spark, d)[0]


def tlp_overrides(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("audit_id"), F.col("user_id").alias("article_id"), F.when(F.col("event_type") == "error", "tlp_override").otherwise("other").alias("kind"), F.col("ts").alias("at"))
    return A.overrides(e, "article_id").where("nth <= 2").select("audit_id", "article_id", "nth")


def report_texts(spark, d):
    docs = table(spark, d, "documents")
    blank = lambda k, c: F.when(F.col("doc_id") % k != 0, c)
    rows = docs.select(
        "doc_id", blank(7, F.col("lang")).alias("title"), blank(3, F.lit(" It is so. ")).alias("key_judgement"), blank(2, F.lit("high")).alias("confidence"), blank(5, F.concat(F.lit("Summary in "), "lang")).alias("summary_md"),
        blank(4, F.lit("Patch.")).alias("recommendations_md"), blank(6, F.lit("One cluster.")).alias("cluster_summary"),
        F.array(A.actor_line(F.col("source"), _pick(("known_actor", "tool", "cluster_designator", "vendor_named", "none"), F.col("doc_id")), F.lit("own list"), F.array(F.upper("source"), F.lit("Other Name")), F.lit("by its last word"))).alias("actor_lines"),
        blank(2, F.lit("likely")).alias("likelihood"), blank(8, F.lit("A note.")).alias("false_flag_note"), F.lit(None).cast("string").alias("shared_infrastructure_note"), F.col("source").alias("source_name"), F.lit("").alias("published"), F.concat(F.lit("http://x/"), "doc_id").alias("source_url"),
    )
    return A.report(rows, "doc_id")


def cluster_texts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", A.cluster_text(F.when(F.col("doc_id") % 3 != 0, F.concat_ws(" ", "lang", "source")), F.col("text")).alias("t"))
    return docs.select("doc_id", F.length("t").alias("n"), F.sha2("t", 256).alias("h"))


def encoded_articles(spark, d):
    """Articles by the mean of given vectors, a word's vector being that of its hash."""
    words = table(spark, d, "conversations").select("conv_id", F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]{3,})"))).alias("w"))
    tokens = words.select("conv_id", F.pmod(F.length("w") * 31 + F.ascii("w") * 7 + F.ascii(F.reverse("w")), F.lit(600)).cast("long").alias("word"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("word"), F.slice("embedding", 1, WIDTH).alias("vector"))
    out = A.encoded(tokens, "conv_id", "word", vectors, WIDTH)
    return out.select("conv_id", F.posexplode("vector").alias("k", "x")).select("conv_id", "k", F.round(F.col("x").cast("double"), 4).alias("x"))


def role_checks(spark, d):
    c = table(spark, d, "customer").select("c_custkey", _pick((*G.ROLES, "guest"), F.col("c_custkey")).alias("role"), _pick(G.ROLES, F.floor(F.col("c_custkey") / 4)).alias("least"))
    return c.select("c_custkey", G.role_at_least(F.col("role"), F.col("least")).alias("allowed"))


def last_admin(spark, d):
    """With one active admin and with two."""
    role = F.when(F.col("s_suppkey").between(1, 2), "admin").otherwise("viewer").alias("role")
    users = lambda active: table(spark, d, "supplier").select("s_suppkey", role, active.alias("active"))
    one, two = G.may_leave(users(F.col("s_suppkey") != 2), "s_suppkey"), G.may_leave(users(F.lit(True)), "s_suppkey")
    return one.withColumn("admins", F.lit(1)).unionByName(two.withColumn("admins", F.lit(2)))


def page_filtered(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    return G.page_then_filter(docs, [F.desc("n_chars"), "doc_id"], 2, 50, F.col("lang") == "en").select("doc_id")


def newest_article(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("at"), F.when(F.col("event_type") == "purchase", F.col("props")).alias("body"))
    return G.newest_with_body(e, "body", "at", "event_id").select("event_id")


def public_urls(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    host = _pick(("example.com", "10.0.0.8", "localhost", "8.8.8.8", "[::1]", "192.168.1.1", "[2606:4700::1111]", "169.254.1.1", "224.0.0.1", ""), F.col("c_custkey"))
    return c.select("c_custkey", G.public_url(F.concat(F.when(F.col("c_custkey") % 11 == 0, "ftp").otherwise("https"), F.lit("://"), host, F.lit("/hook"))).alias("public"))


def location_changes(spark, d):
    current = table(spark, d, "supplier").select(F.col("s_suppkey").alias("group_id"), F.concat("s_name", F.lit(".onion")).alias("fqdn"), (F.col("s_suppkey") % 2 == 0).alias("available"))
    new = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").alias("group_id"), F.concat(F.lit("Supplier#"), F.lpad((F.col("l_suppkey") + F.col("l_partkey") % 2).cast("string"), 9, "0"), F.lit(".onion")).alias("fqdn"), (F.col("l_suppkey") % 3 == 0).alias("available"))
    return G.upsert_locations(current, new)[1]


def contacts_appended(spark, d):
    c = table(spark, d, "customer")
    row = lambda df, v: df.select(F.col("c_nationkey").alias("group_id"), F.lower("c_mktsegment").alias("kind"), v.alias("value"))
    out = G.append_contacts(row(c.where("c_custkey % 2 = 0"), F.concat(F.lit("user"), F.col("c_custkey") % 20)).distinct(), row(c, F.concat(F.lit("USER"), F.col("c_custkey") % 20)))
    return out.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    style_breaches, style_report, style_clean, style_rows, style_worst, article_progress, attempt_ladder, ingest_phases, named_actors, grounded_actors, projected_columns, promoted_infrastructure, payload_corroboration, synonym_pairs,
    regrade_audit, source_grades, tlp_overrides, report_texts, cluster_texts, encoded_articles, role_checks, last_admin, page_filtered, newest_article, public_urls, location_changes, contacts_appended,
)}

_STATES = "[" + ", ".join(repr(s) for s in A.STATES) + "]"
_FIND = """f AS (SELECT o_orderkey AS article_id, CASE WHEN o_orderkey % 5 < 4 THEN 'ioc' ELSE 'ttp' END AS finding_kind, o_orderstatus = 'F' AS auto, CASE o_custkey % 4 WHEN 0 THEN 'btc_addresses' WHEN 1 THEN 'profile_urls' END AS field,
CASE WHEN o_custkey % 4 = 0 THEN 'wallet' || (o_custkey % 90) ELSE 'http://host' || (o_custkey % 60) || '.onion/' END AS value, CASE WHEN o_custkey % 4 > 0 THEN 'host' || (o_custkey % 60) || '.onion' END AS host, o_custkey % 30 AS target FROM orders)"""
_PICKED = lambda values, c: "[" + ", ".join(repr(v) for v in values) + f"][({c}) % {len(values)} + 1]"
ORACLES = {
    # breaches of each phrase, counted by hand
    "style_rows": f"""WITH p AS (SELECT source, {_PICKED((2, 3, 3, 0, 2, 3, 2, 0), 'doc_id')} AS n FROM documents) SELECT source, CAST(sum(n) AS BIGINT) AS breaches, count(*) FILTER (n > 0) AS texts FROM p GROUP BY 1 HAVING sum(n) > 0""",
    "style_clean": f"""WITH p AS (SELECT source, {_PICKED((2, 3, 3, 0, 2, 3, 2, 0), 'doc_id')} AS n FROM documents)
SELECT source, count(*) AS runs, count(*) FILTER (n = 0) AS clean, CAST(sum(n) AS BIGINT) AS breaches, round(count(*) FILTER (n = 0) / count(*), 6) AS share FROM p GROUP BY 1""",
    "article_progress": f"""WITH s AS (SELECT doc_id, text, i, {_STATES}[i + 1] AS state, CASE WHEN i >= doc_id % 9 THEN '' WHEN (doc_id + 3 * i) % 11 = 0 THEN {_PICKED(('staged', 'error', 'dropped', 'month cap'), 'doc_id')} ELSE 'ok' END AS status FROM documents, range(8) r(i)),
h AS (SELECT doc_id, doc_id % 13 = 0 OR coalesce(any_value(text), '') = '' AS blank, min(i) FILTER (status <> 'ok') AS i, arg_min(status, i) FILTER (status <> 'ok') AS status FROM s GROUP BY doc_id)
SELECT doc_id, CAST(CASE WHEN blank THEN 0 ELSE coalesce(i, 8) END AS INTEGER) AS done, CASE WHEN blank THEN 'triage' WHEN i IS NULL THEN '' ELSE {_STATES}[i + 1] END AS at,
CASE WHEN blank THEN 'the article has no body' WHEN i IS NULL THEN 'finished' WHEN status = 'dropped' THEN 'not relevant' WHEN status = '' THEN 'next' ELSE status END AS why FROM h""",
    "attempt_ladder": f"""WITH e AS (SELECT user_id, event_type, event_id, {_PICKED(('failed', 'rejected', 'answered', 'failed', 'refused', 'rejected', 'irrelevant', 'unwired'), 'CAST(floor(value) AS BIGINT)')} AS o, 'd' || (event_id % 3) AS d FROM events),
g AS (SELECT user_id, event_type, coalesce(min(event_id) FILTER (o IN ('answered', 'irrelevant', 'refused', 'unwired')), max(event_id)) AS at FROM e GROUP BY 1, 2)
SELECT g.user_id, g.event_type, CASE x.o WHEN 'refused' THEN x.d WHEN 'answered' THEN 'ok' WHEN 'irrelevant' THEN 'dropped' WHEN 'rejected' THEN 'staged' ELSE 'error' END AS status,
CAST((SELECT count(*) FROM e y WHERE y.user_id = g.user_id AND y.event_type = g.event_type AND y.event_id <= g.at AND y.o <> 'refused') AS INTEGER) AS attempts, x.d AS detail FROM g JOIN e x ON x.event_id = g.at""",
    "ingest_phases": """WITH s AS (SELECT 'feed' || r_regionkey * 2 AS source, r_regionkey % 2 = 0 AS enabled FROM region), a AS (SELECT * FROM s UNION ALL SELECT 'feed' || n_nationkey, true FROM nation WHERE 'feed' || n_nationkey NOT IN (SELECT source FROM s)),
h AS (SELECT url, 'feed' || min(page_id) % 20 AS source, min(page_id) % 2 = 0 AS body FROM pages WHERE page_id % 3 = 0 GROUP BY 1),
e AS (SELECT url, min('feed' || page_id % 20) AS source FROM pages WHERE 'feed' || page_id % 20 IN (SELECT source FROM a WHERE enabled) AND url NOT IN (SELECT url FROM h) GROUP BY 1), b AS (SELECT * FROM h UNION ALL SELECT url, source, false FROM e)
SELECT 'sources' AS phase, count(*) AS n FROM a UNION ALL SELECT 'articles', count(*) FROM b UNION ALL SELECT 'queue', count(*) FROM b JOIN a USING (source) WHERE NOT body AND enabled""",
    "projected_columns": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE 'kind' || doc_id % 4 END AS article_type, CASE WHEN doc_id % 5 = 0 THEN lang ELSE 'sum ' || lang END AS summary_md,
coalesce(CASE WHEN doc_id % 5 = 0 THEN source WHEN doc_id % 2 = 1 THEN 'act' END, 'none') AS recommendations_md FROM documents""",
    "promoted_infrastructure": f"WITH {_FIND} SELECT article_id, field, string_agg(DISTINCT value, ',' ORDER BY value) AS values FROM f WHERE finding_kind = 'ioc' AND auto AND field IS NOT NULL AND coalesce(host, value) NOT IN (SELECT 'host' || (s_suppkey % 25) || '.onion' FROM supplier) GROUP BY 1, 2",
    "payload_corroboration": f"WITH {_FIND} SELECT finding_kind, target, value, count(DISTINCT source) AS sources FROM f JOIN documents ON doc_id = article_id WHERE doc_id % 7 <> 0 AND source IS NOT NULL GROUP BY 1, 2, 3",
    "synonym_pairs": """WITH k AS (SELECT DISTINCT lower(p_name) AS key, p_name AS target FROM part UNION SELECT p_name || ' 0', p_name FROM part WHERE p_partkey % 3 = 0 AND p_size > 25)
SELECT DISTINCT p_name || ' ' || p_partkey % 3 AS name, target FROM part JOIN k ON key = lower(p_name) WHERE p_size % 2 = 0 AND p_name || ' ' || p_partkey % 3 NOT IN (SELECT key FROM k)""",
    "regrade_audit": f"""SELECT s_name AS name, {_PICKED('ABCDEF', 's_suppkey')} AS before, {_PICKED('AABC', 's_suppkey')} AS after, 'analyst' AS by, '2024-01-31' AS at FROM supplier WHERE s_nationkey < 12 AND {_PICKED('ABCDEF', 's_suppkey')} <> {_PICKED('AABC', 's_suppkey')}""",
    "source_grades": f"SELECT s_name AS name, CASE WHEN s_nationkey < 12 THEN {_PICKED('AABC', 's_suppkey')} ELSE {_PICKED('ABCDEF', 's_suppkey')} END AS grade FROM supplier",
    "tlp_overrides": "SELECT event_id AS audit_id, user_id AS article_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS nth FROM events WHERE event_type = 'error' QUALIFY nth <= 2",
    "report_texts": r"""WITH p AS (SELECT doc_id, doc_id % 7 <> 0 AS t, doc_id % 3 <> 0 AS j, doc_id % 2 <> 0 AS c, doc_id % 5 <> 0 AS s, doc_id % 4 <> 0 AS r, doc_id % 6 <> 0 AS k, doc_id % 8 <> 0 AS f, lang, source,
CASE doc_id % 5 WHEN 0 THEN '- **' || source || '**, also known as Other Name (own list)' WHEN 1 THEN '- ' || source || ' — tool, not an actor (own list)' WHEN 2 THEN '- ' || source || ' — a cluster own list has not named' WHEN 3 THEN '- ' || source || ' — by its last word'
ELSE '- ' || source || ' — recognised by no catalogue held here' END AS line, chr(10) || chr(10) AS n FROM documents)
SELECT doc_id, '# ' || CASE WHEN t THEN lang ELSE 'Untitled report' END || chr(10) || '*Title as published by the source; this report has none of its own.*' || n || CASE WHEN j THEN '**Bottom line.** It is so.' || CASE WHEN c THEN ' (high)' ELSE '' END || n ELSE '' END
|| CASE WHEN s THEN '## What the reporting establishes' || n || 'Summary in ' || lang || n ELSE '' END || '## The adversary' || n || CASE WHEN k THEN 'One cluster.' || n ELSE '' END || line || n || CASE WHEN c THEN 'Assessed likelihood: likely.' || n ELSE '' END
|| CASE WHEN f THEN '## Gaps and deception' || n || 'A note.' || n ELSE '' END || CASE WHEN r THEN '## Recommended action' || n || 'Patch.' || n ELSE '' END || '## Source' || n || source || ' · http://x/' || doc_id || chr(10) AS markdown FROM p""",
    "cluster_texts": "WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN lang || ' ' || source || ' ' || lang || ' ' || source || ' ' || substring(coalesce(text, ''), 1, 4000) ELSE coalesce(text, '') END AS t FROM documents) SELECT doc_id, CAST(length(t) AS INTEGER) AS n, sha256(t) AS h FROM t",
    "encoded_articles": f"""WITH w AS (SELECT conv_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{3,}}')) AS w FROM conversations), t AS (SELECT conv_id, (length(w) * 31 + ascii(w) * 7 + ascii(reverse(w))) % 600 AS word FROM w),
m AS (SELECT conv_id, k, avg(CAST(embedding[k + 1] AS DOUBLE)) AS x FROM t LEFT JOIN embeddings ON vec_id = word CROSS JOIN range({WIDTH}) r(k) GROUP BY 1, 2), n AS (SELECT *, sqrt(sum(coalesce(x, 0) * coalesce(x, 0)) OVER (PARTITION BY conv_id)) AS n FROM m)
SELECT conv_id, CAST(k AS INTEGER) AS k, round(CASE WHEN n > 0 THEN coalesce(x, 0) / n ELSE 0 END, 4) AS x FROM n""",
    "role_checks": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN false ELSE c_custkey % 4 >= (c_custkey // 4) % 3 END AS allowed FROM customer",
    "last_admin": "SELECT s_suppkey, s_suppkey <> 1 AS may_leave, 1 AS admins FROM supplier UNION ALL SELECT s_suppkey, true, 2 FROM supplier",
    "page_filtered": "SELECT doc_id FROM (SELECT doc_id, lang FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 50) WHERE lang = 'en'",
    "newest_article": "SELECT event_id FROM events WHERE event_type = 'purchase' AND props <> '' ORDER BY CASE WHEN event_id % 2 = 0 THEN ts END DESC NULLS LAST, event_id DESC LIMIT 1",
    "public_urls": "SELECT c_custkey, c_custkey % 11 <> 0 AND c_custkey % 10 IN (0, 3, 6) AS public FROM customer",
    "location_changes": """WITH n AS (SELECT l_suppkey AS group_id, 'Supplier#' || lpad(CAST(l_suppkey + l_partkey % 2 AS VARCHAR), 9, '0') || '.onion' AS fqdn, bool_or(l_suppkey % 3 = 0) AS a FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2)
SELECT group_id, fqdn, CASE WHEN s_suppkey IS NULL THEN 'inserted' ELSE 'updated' END AS change FROM n LEFT JOIN supplier ON s_suppkey = group_id AND s_name || '.onion' = fqdn WHERE s_suppkey IS NULL OR a <> (s_suppkey % 2 = 0)""",
    "contacts_appended": "SELECT c_nationkey AS group_id, count(DISTINCT (c_mktsegment, c_custkey % 20)) AS n FROM customer GROUP BY 1",
}
