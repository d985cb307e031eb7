"""Readers: the given tables are written as the files that feeds land, in the shared folder, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderlake.functions import tables
from cinderlake.functions import text as T
from cinderlake.operators import contracts as C
from cinderlake.operators import extraction as X
from cinderlake.operators import guards as G
from cinderlake.operators import identity as D
from cinderlake.operators import scoring as S
from cinderlake.operators import updates as U
from cinderlake.session import shared_folder, table
from cinderlake.sources import copying as K
from cinderlake.sources import incidents as N
from cinderlake.sources import markdown as M
from cinderlake.sources import readers as R
from cinderlake.streaming import microbatch as B


def _json(df, label: str) -> str:
    """Feeds land one JSON array per file; these are dealt into eight."""
    path = shared_folder(df.sparkSession, label)
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("j")).withColumn("f", F.pmod(F.xxhash64("j"), F.lit(8)))
    whole = rows.groupBy("f").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value"))
    whole.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


def _lines(df, label: str, compression: str = "none") -> str:
    path = shared_folder(df.sparkSession, label)
    df.write.option("compression", compression).text(path)
    return path


def landed_victims(spark, d):
    o = table(spark, d, "orders")
    raw = o.select(
        F.when(F.col("o_custkey") % 9 != 0, F.concat(F.lit("c"), "o_custkey")).alias("victim"), F.col("o_orderpriority").alias("group_name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("attackdate"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("discovered"), F.when(F.col("o_custkey") % 4 == 0, "").otherwise("a.example").alias("domain"), F.lit("de").alias("country"),
    )
    v = R.victims(spark, _json(raw, "victims"))
    return v.groupBy("group_name", "country").agg(F.count(F.lit(1)).alias("n"), F.count("domain").alias("domains"), F.count_if(F.col("victim_name") == "").alias("unnamed"), F.date_format(F.min("attackdate"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("discovered"), "yyyy-MM-dd").alias("last"))


def landed_groups(spark, d):
    s = table(spark, d, "supplier")
    location = F.struct(F.col("s_name").alias("slug"), F.concat("s_name", F.lit(".onion")).alias("fqdn"), F.lit("t").alias("title"), (F.col("s_suppkey") % 2 == 0).alias("available"), F.lit(True).alias("enabled"))
    raw = s.select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, " ").otherwise("alt").alias("altname"), F.lit(None).cast("string").alias("description"), F.lit("raas").alias("type"), F.when(F.col("s_suppkey") % 3 != 0, F.array(location, location)).alias("locations"))
    g = R.groups(spark, _json(raw, "groups"))
    return g.select("name", F.coalesce("altname", F.lit("none")).alias("altname"), F.coalesce("description", F.lit("none")).alias("description"), F.size("locations").alias("locations"))


def landed_attacks(spark, d):
    e = table(spark, d, "events")
    raw = e.select(F.concat(F.lit("u"), "user_id").alias("victim"), F.when(F.col("event_id") % 2 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date"), F.lit("2024-03-01").alias("attack_date"), F.lower("event_type").alias("country"))
    a = R.attacks(spark, _json(raw, "attacks"))
    return a.groupBy("country", F.date_format("attack_date", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def landed_payments(spark, d):
    o = table(spark, d, "orders")
    tx = F.struct(F.concat(F.lit("h"), F.col("o_orderkey") % 50).alias("hash"), F.unix_timestamp("o_orderdate").alias("time"), (F.col("o_orderkey") % 50 * 100_000_000).alias("amount"), F.lit(2.5).alias("amountUSD"))
    wallets = o.groupBy(F.concat(F.lit("w"), "o_custkey").alias("address")).agg(F.lit("fam").alias("family"), F.lit(0).cast("long").alias("balance"), F.array_sort(F.collect_list(tx)).alias("transactions"))
    # dealt into a few files, half of them a bare list and half below a key, as the feed comes in both forms
    files = wallets.withColumn("f", F.pmod(F.xxhash64("address"), F.lit(8)))
    listed = files.groupBy("f").agg(F.to_json(F.collect_list(F.struct("address", "family", "balance", "transactions"))).alias("j"))
    path = shared_folder(spark, "payments")
    listed.repartition(8, "f").select(F.when(F.col("f") % 2 == 0, F.col("j")).otherwise(F.concat(F.lit('{"result": '), F.col("j"), F.lit("}"))).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    p = R.payments(spark, path)
    return p.groupBy("address").agg(F.count(F.lit(1)).alias("n"), F.sum("btc").cast("double").alias("btc"), F.sum("usd").cast("double").alias("usd"))


def landed_spans(spark, d):
    c = table(spark, d, "customer")
    ip = lambda n: F.concat_ws(".", F.lit("10"), F.lit("0"), F.floor(n / 250), n % 250)
    line = F.concat_ws("\t", ip(F.col("c_custkey")), ip(F.col("c_custkey") + 1), F.element_at(F.array(*map(F.lit, (9009, 1, 13335, 2))), (F.col("c_custkey") % 4 + 1).cast("int")).cast("string"), F.lit("DE"), F.col("c_name"))
    return R.asn_spans(spark, _lines(c.select(line.alias("value")), "spans", "gzip"))


def landed_exits(spark, d):
    s = table(spark, d, "supplier")
    lines = s.select(F.explode(F.array(F.concat(F.lit("ExitNode "), "s_name"), F.concat(F.lit("ExitAddress 10.1.2."), F.col("s_suppkey") % 200, F.lit(" 2024-01-01")))).alias("value"))
    return R.exit_addresses(spark, _lines(lines, "exits")).distinct()


def landed_fields(spark, d):
    """The second field of files of several lines, each with a head and a line left by a merge."""
    n = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda k: F.concat(F.lit("x, 10.9."), F.floor(k / 250), F.lit("."), k % 250, F.lit(" ,y"))), "\n").alias("rows"))
    whole = n.repartition(8).select(F.concat(F.lit("name,ip\n<<<<<<< HEAD,1\n"), "rows", F.lit("\nshort")).alias("value"))
    path = shared_folder(spark, "fields")
    whole.write.option("maxRecordsPerFile", 1).text(path)
    return R.column_of(spark, path, 1).groupBy("address").agg(F.count(F.lit(1)).alias("n"))


def _bundle(spark, d):
    part = table(spark, d, "part")
    kind = F.element_at(F.array(*map(F.lit, ("intrusion-set", "attack-pattern", "malware", "tool", "identity"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    ext = F.array(F.struct(F.lit("other").alias("source_name"), F.lit("x").alias("external_id")), F.struct(F.lit("mitre-attack").alias("source_name"), F.concat(F.lit("T"), "p_partkey").alias("external_id")))
    node = part.select(
        kind.alias("type"), F.concat(F.lit("n"), "p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 7 == 0).alias("revoked"), F.when(F.col("p_size") % 2 == 0, F.lit("2023-05-01T00:00:00Z")).when(F.col("p_size") % 3 == 0, "2024-06-01T00:00:00Z").alias("modified"), ext.alias("external_references"),
        F.lit(None).cast("string").alias("relationship_type"), F.lit(None).cast("string").alias("source_ref"), F.lit(None).cast("string").alias("target_ref"),
    )
    edge = part.select(
        F.lit("relationship").alias("type"), F.concat(F.lit("r"), "p_partkey").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("revoked"), F.lit(None).cast("string").alias("modified"), F.lit(None).cast(node.schema["external_references"].dataType).alias("external_references"),
        F.when(F.col("p_partkey") % 2 == 0, "uses").otherwise("targets").alias("relationship_type"), F.concat(F.lit("n"), "p_partkey").alias("source_ref"), F.concat(F.lit("n"), F.col("p_partkey") + 1).alias("target_ref"),
    )
    objects = node.unionByName(edge)
    files = objects.withColumn("f", F.pmod(F.xxhash64("id"), F.lit(8))).groupBy("f").agg(F.collect_list(F.struct(*objects.columns)).alias("objects"))
    path = shared_folder(spark, "bundle")
    files.repartition(8, "f").select("objects").write.option("maxRecordsPerFile", 1).json(path)
    return R.bundle(spark, path)


def bundle_nodes(spark, d):
    return R.bundle_nodes(_bundle(spark, d)).select("id", "kind", "external_id", "name")


def bundle_changed(spark, d):
    return R.modified_since(R.bundle_nodes(_bundle(spark, d)), "2024-01-01 00:00:00").select("id")


def bundle_uses(spark, d):
    return R.bundle_edges(_bundle(spark, d))


def landed_feed(spark, d):
    """Half of the pages as items of RSS, half as Atom entries, some of which were only updated."""
    p = table(spark, d, "pages")
    item = F.concat(F.lit("<item><title>t"), "page_id", F.lit("</title><link> http://x/"), "page_id", F.lit(" </link><description>d</description><pubDate>Tue, 02 Jan 2024 03:04:05 +0100</pubDate></item>"))
    when = F.when(F.col("page_id") % 3 == 0, F.lit("<updated>2024-05-06T07:08:09Z</updated>")).otherwise(F.lit("<published>2024-01-02T03:04:05+01:00</published><updated>2024-05-06T07:08:09Z</updated>"))
    entry = F.concat(F.lit("<entry><title>t"), "page_id", F.lit('</title><link href="http://x/'), "page_id", F.lit('"/><summary>d</summary>'), when, F.lit("</entry>"))
    rows = p.select(F.when(F.col("page_id") % 2 == 0, item).otherwise(entry).alias("i"), (F.col("page_id") % 2 == 0).alias("rss"))
    listed = rows.groupBy("rss", F.pmod(F.xxhash64("i"), F.lit(8))).agg(F.array_join(F.collect_list("i"), "").alias("all"))
    whole = listed.select(F.when(F.col("rss"), F.concat(F.lit("<rss><channel>"), "all", F.lit("</channel></rss>"))).otherwise(F.concat(F.lit("<feed>"), "all", F.lit("</feed>"))).alias("value"))
    path = shared_folder(spark, "feed")
    whole.write.option("maxRecordsPerFile", 1).text(path)
    f = R.feed_items(spark, path)
    return f.select("title", "link", "summary", F.date_format("published", "yyyy-MM-dd HH:mm").alias("published"))


def incident_history(spark, d):
    """The first halves of three years out of a landed history of all orders, a folder per year and month."""
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.concat(F.lit("c"), "o_custkey").alias("victim"), F.col("o_orderpriority").alias("group_name"), F.substring("o_orderstatus", 1, 1).alias("country"))
    entry = F.to_json(F.struct("victim", "group_name", "country"))
    files = o.groupBy("year", "month", F.pmod(F.xxhash64("victim"), F.lit(2)).alias("f")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(entry), ","), F.lit("]")).alias("value"))
    root = shared_folder(spark, "incidents")
    files.repartition("year", "month").select("year", "month", "value").write.partitionBy("year", "month").option("maxRecordsPerFile", 1).text(f"{root}/leaks/victims_history")
    rows = N.feed(spark, root, "leaks", "victims_history", years="1993-1995", months="1-6")
    return rows.groupBy("year", "month", "country").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("victim_name").alias("victims"))


def _markdown(spark, files, label: str) -> str:
    path = shared_folder(spark, label)
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


def telegram_channels(spark, d):
    """A table per nation; a customer without a link in the cell, or without a name, has no row."""
    c = table(spark, d, "customer")
    cell = F.when(F.col("c_custkey") % 7 == 0, F.lit("closed")).otherwise(F.concat(F.lit("[t](https://t.me/c"), "c_custkey", F.lit(")")))
    row = F.concat(F.lit("| "), cell, F.lit(" | "), F.when(F.col("c_custkey") % 2 == 0, "valid").otherwise("expired"), F.lit(" | "), "c_name", F.lit(" | ddos |"))
    files = c.groupBy("c_nationkey").agg(F.concat(F.lit("text\n\n| Telegram | Status | Name | Type |\n|:--|---|---|---|\n"), F.array_join(F.collect_list(row), "\n"), F.lit("\n\nend")).alias("value"))
    return M.parsed(spark, _markdown(spark, files, "telegram"), M.telegram, "name,url,status,attack_type").select("name", "url", "status", "attack_type")


def twitter_accounts(spark, d):
    """The state is the first cell after the name that is one."""
    s = table(spark, d, "supplier")
    state = F.when(F.col("s_suppkey") % 3 == 0, "suspended").when(F.col("s_suppkey") % 3 == 1, "online").otherwise("unclear")
    row = F.concat(F.lit("| https://x.com/s"), "s_suppkey", F.lit(" | "), "s_name", F.lit(" | note | "), state, F.lit(" |"))
    files = s.groupBy("s_nationkey").agg(F.concat(F.lit("| Link | Name | Note | Status |\n|---|---|---|---|\n"), F.array_join(F.collect_list(row), "\n")).alias("value"))
    return M.parsed(spark, _markdown(spark, files, "twitter"), M.twitter, "name,url,status").select("name", "url", "status")


def markdown_gangs(spark, d):
    """One table of Markdown per nation, in files of their own."""
    s = table(spark, d, "supplier")
    row = F.concat(F.lit("| ["), "s_name", F.lit(" (Dark)](http://g"), "s_suppkey", F.lit(".onion) | "), F.when(F.col("s_suppkey") % 2 == 0, "online").otherwise("offline"), F.lit(" | | |"))
    files = s.groupBy("s_nationkey").agg(F.concat(F.lit("# Gangs\n\n| Name | Status | Credentials | Contact |\n|---|---|---|---|\n"), F.array_join(F.array_sort(F.collect_list(row)), "\n"), F.lit("\n| RansomFeed | online | | |\n\nend")).alias("value"))
    path = shared_folder(spark, "gangs")
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return M.parsed(spark, path, M.gangs, "name,url,status,credentials,comms_raw,rss").select("name", "url", "status")


def markdown_lines(spark, d):
    """Rows of one table per nation out of the lines of its file, by a table function over partitions."""
    tables.register(spark)
    o = table(spark, d, "customer")
    row = F.concat(F.lit("| C"), "c_custkey", F.lit(" | "), "c_mktsegment", F.lit(" |"))
    body = o.select(F.concat(F.lit("n"), "c_nationkey").alias("file"), (F.col("c_custkey") + 10).alias("pos"), row.alias("line"))
    heads = o.select(F.concat(F.lit("n"), "c_nationkey").alias("file")).distinct()
    frame = heads.select("file", F.inline(F.array(*[F.struct(F.lit(p).cast("bigint").alias("pos"), F.lit(t).alias("line")) for p, t in ((0, "| stray |"), (1, ""), (2, "| Name | Segment |"), (3, "|---|---|"), (1 << 60, "end"), ((1 << 60) + 1, "| after | all |"))])))
    found = spark.sql("SELECT * FROM markdown_lines(TABLE({lines}) PARTITION BY (file) ORDER BY (pos), 'name')", lines=body.unionByName(frame))
    return found.select("file", "pos", F.array_join("cells", "/").alias("cells"))


def feed_polls(spark, d):
    """A feed per nation, of which some are off, landed nothing, or landed what can't be read beside what can."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("feed"), (F.col("n_nationkey") % 4 != 1).alias("enabled"))
    s = table(spark, d, "supplier").where("s_nationkey % 7 <> 3").withColumn("f", F.pmod("s_suppkey", F.lit(2)))
    listed = s.groupBy(F.col("s_nationkey").alias("feed"), "f").agg(F.to_json(F.collect_list(F.struct(F.col("s_name").alias("title")))).alias("j"))
    broken = (F.col("feed") % 5 == 0) | ((F.col("feed") % 3 == 0) & (F.col("f") == 0))
    path = shared_folder(spark, "polls")
    listed.select("feed", F.when(broken, F.concat(F.lit("<html>"), "j")).otherwise(F.col("j")).alias("value")).repartition("feed").write.partitionBy("feed").option("maxRecordsPerFile", 1).text(path)
    entries, status = G.polled(n, spark.read.schema("value string, feed int").text(path, wholetext=True), "struct<title:string>")
    found = entries.groupBy("feed").agg(F.count_distinct("title").alias("titles"))
    return status.join(found, "feed", "left").select("feed", "status", "texts", "unreadable", "entries", F.coalesce("titles", F.lit(0)).alias("titles"))


def copied_tables(spark, d):
    """Four tables copied by their references into a database whose orders lack a column; orders of some customers lose them on the way."""
    source = {t: table(spark, d, t) for t in ("orders", "customer", "nation", "region")}
    source["customer"] = source["customer"].where("c_custkey % 11 <> 0")
    target = {t: ["note", *[c for c in df.columns if c != "o_orderpriority"]] for t, df in source.items()}
    refs = [("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey")]
    root = shared_folder(spark, "copy")
    keys = {"orders": "o_orderkey", "customer": "c_custkey", "nation": "n_nationkey"}
    out = K.copy_database(spark, source, target, refs, keys, lambda rows, name: rows.write.parquet(f"{root}/{name}"), lambda name: spark.read.parquet(f"{root}/{name}"))
    return out.withColumn("next_id", F.coalesce("next_id", F.lit(0)))


def contact_kinds(spark, d):
    c = table(spark, d, "customer")
    raw = F.concat(F.lit("https://t.me/u"), "c_custkey", F.lit(" - mail"), "c_custkey", F.lit("@x.org, http://site"), F.col("c_custkey") % 3, F.lit(".com | words only"))
    found = c.select(F.explode(M.contacts(raw)).alias("c"))
    return found.groupBy("c.kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c.value").alias("values"))


def incremental_matches(spark, d):
    """Old watch rows against new orders and new watch rows against all, without known pairs."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), (F.col("o_custkey") % 40).alias("k"))
    watch = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("watch_id"), F.col("n_nationkey").cast("long").alias("k"))
    match = lambda w, rows: w.join(rows, "k").select("watch_id", "row_id")
    known = o.where("row_id % 100 = 1").select(F.col("k").alias("watch_id"), "row_id")
    out = B.incremental_pairs(watch.where("watch_id < 20"), watch.where("watch_id >= 20"), o, o.where("row_id % 10 = 1"), match, known, ["watch_id", "row_id"])
    return out.groupBy("watch_id").agg(F.count(F.lit(1)).alias("n"))


def event_windows(spark, d):
    """Counts per day and type of a stream of the events' files, as its sink holds them in the end."""
    schema = table(spark, d, "events").schema
    stream = B.read_increments(spark, f"{d}/events.parquet*", schema).withColumn("at", F.col("ts").cast("timestamp"))
    out = shared_folder(spark, "windows")
    write = lambda rows, number: rows.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.lit(number).alias("batch")).write.mode("append").parquet(out)
    query = B.windowed_counts(stream, "at", "1 day", "1 hour", ["event_type"]).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", shared_folder(spark, "windows-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).groupBy("day", "event_type").agg(F.max_by("n", "batch").alias("n"))


def structure_drift(spark, d):
    """Drift of one structure per type against another type's, path by path."""
    by = C.dataset_structure(table(spark, d, "events").withColumn("props", F.when(F.col("event_type") == "click", F.regexp_replace("props", '"k"', '"q"')).otherwise(F.col("props"))), ["event_type"], "props", "event_id")
    old = by.where("event_type = 'view'").select(F.col("structure").alias("old"))
    return C.drift(by.crossJoin(F.broadcast(old)), "event_type", "old", "structure")


def unreachable_floors(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 10_000).alias("most"), (F.col("s_suppkey") % 10 / 10).alias("floor"))
    return U.reachable(s, "s_suppkey", "most", "floor")


def token_prices(spark, d):
    p = table(spark, d, "lineitem").select("l_suppkey", S.price(F.col("l_orderkey"), F.col("l_partkey"), 3.0, 15.0).alias("p"))
    return p.groupBy("l_suppkey").agg(F.round(F.sum("p").cast("double"), 3).alias("spent"))


def merged_aliases(spark, d):
    part = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("old"), F.array_sort(F.collect_set(F.initcap("p_type"))).alias("new"))
    return part.select("p_brand", F.array_join(T.merge_aliases(F.col("old"), F.concat("new", F.array(F.col("p_brand"), F.lit("Zed"))), F.col("p_brand")), ",").alias("aliases"))


def software_groups(spark, d):
    s = table(spark, d, "part").select(F.element_at(F.array(*[F.lit(x) for x in ("REvil", "sodinokibi ", "Phobos", "unknown")]), (F.col("p_partkey") % 4 + 1).cast("int")).alias("software"))
    groups = table(spark, d, "region").select("r_regionkey", F.element_at(F.array(*[F.lit(x) for x in ("REvil", "phobos", "a", "b", "c")]), F.col("r_regionkey").cast("int") + 1).alias("name"))
    return D.software_matches(s, "software", groups, "r_regionkey", "name")


def lowered_levels(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("doc_id") % 3 + 1).cast("int")).alias("level"))
    return docs.select("doc_id", X.lower_if_unanchored(F.col("level"), F.coalesce(F.col("text").contains("the "), F.lit(False))).alias("level"))


QUERIES = {f.__name__: f for f in (
    landed_victims, landed_groups, landed_attacks, landed_payments, landed_spans, landed_exits, landed_fields, bundle_nodes, bundle_changed, bundle_uses, landed_feed, incident_history, markdown_gangs, markdown_lines, feed_polls, copied_tables, telegram_channels, twitter_accounts, contact_kinds, incremental_matches, event_windows,
    structure_drift, unreachable_floors, token_prices, merged_aliases, software_groups, lowered_levels,
)}

_NODE = """n AS (SELECT p_partkey, 'n' || p_partkey AS id, ['group', 'technique', 'software', 'software', NULL][p_partkey % 5 + 1] AS kind, 'T' || p_partkey AS external_id, p_name AS name, p_size FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 4)"""
ORACLES = {
    "landed_victims": """SELECT o_orderpriority AS group_name, 'DE' AS country, count(*) AS n, count(*) FILTER (o_custkey % 4 <> 0) AS domains, count(*) FILTER (o_custkey % 9 = 0) AS unnamed, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders GROUP BY 1""",
    "landed_groups": "SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'none' ELSE 'alt' END AS altname, 'none' AS description, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 2 END AS INTEGER) AS locations FROM supplier",
    "landed_attacks": "SELECT upper(event_type) AS country, CASE WHEN event_id % 2 = 0 THEN '2024-03-01' ELSE strftime(ts, '%Y-%m-%d') END AS day, count(*) AS n FROM events GROUP BY 1, 2",
    "landed_payments": "WITH t AS (SELECT DISTINCT 'w' || o_custkey AS address, o_orderkey % 50 AS h FROM orders) SELECT address, count(*) AS n, CAST(sum(h) AS DOUBLE) AS btc, count(*) * 2.5 AS usd FROM t GROUP BY 1",
    "landed_spans": "SELECT '10.0.' || c_custkey // 250 || '.' || c_custkey % 250 AS first, '10.0.' || (c_custkey + 1) // 250 || '.' || (c_custkey + 1) % 250 AS last FROM customer WHERE c_custkey % 2 = 0",
    "landed_exits": "SELECT DISTINCT '10.1.2.' || s_suppkey % 200 AS address FROM supplier",
    "landed_fields": "SELECT '10.9.' || c_custkey // 250 || '.' || c_custkey % 250 AS address, count(*) AS n FROM customer GROUP BY 1",
    "bundle_nodes": f"WITH {_NODE} SELECT id, kind, external_id, name FROM n",
    "bundle_changed": f"WITH {_NODE} SELECT id FROM n WHERE p_size % 2 <> 0",
    "bundle_uses": "SELECT 'n' || p_partkey AS src, 'n' || (p_partkey + 1) AS dst FROM part WHERE p_partkey % 2 = 0",
    "landed_feed": "SELECT 't' || page_id AS title, 'http://x/' || page_id AS link, 'd' AS summary, CASE WHEN page_id % 6 = 3 THEN '2024-05-06 07:08' ELSE '2024-01-02 02:04' END AS published FROM pages",
    "incident_history": """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, o_orderstatus[1] AS country, count(*) AS n, count(DISTINCT o_custkey) AS victims FROM orders
WHERE year(o_orderdate) BETWEEN 1993 AND 1995 AND month(o_orderdate) <= 6 GROUP BY 1, 2, 3""",
    "telegram_channels": "SELECT c_name AS name, 'https://t.me/c' || c_custkey AS url, CASE WHEN c_custkey % 2 = 0 THEN 'VALID' ELSE 'EXPIRED' END AS status, 'ddos' AS attack_type FROM customer WHERE c_custkey % 7 <> 0",
    "twitter_accounts": "SELECT s_name AS name, 'https://x.com/s' || s_suppkey AS url, CASE s_suppkey % 3 WHEN 0 THEN 'SUSPENDED' WHEN 1 THEN 'ONLINE' ELSE '' END AS status FROM supplier",
    "feed_polls": """WITH t AS (SELECT s_nationkey AS feed, s_suppkey % 2 AS f, count(*) AS k FROM supplier WHERE s_nationkey % 7 <> 3 AND s_nationkey % 4 <> 1 GROUP BY 1, 2),
g AS (SELECT feed, count(*) AS texts, count(*) FILTER (feed % 5 = 0 OR feed % 3 = 0 AND f = 0) AS bad, coalesce(sum(k) FILTER (NOT (feed % 5 = 0 OR feed % 3 = 0 AND f = 0)), 0) AS entries FROM t GROUP BY 1)
SELECT n_nationkey AS feed, CASE WHEN n_nationkey % 4 = 1 THEN 'off' WHEN texts IS NULL THEN 'missing' WHEN texts = bad THEN 'unreadable' ELSE 'ok' END AS status, coalesce(texts, 0) AS texts, coalesce(bad, 0) AS unreadable,
CAST(coalesce(entries, 0) AS BIGINT) AS entries, CAST(coalesce(entries, 0) AS BIGINT) AS titles FROM nation LEFT JOIN g ON feed = n_nationkey""",
    "copied_tables": """SELECT 'region' AS table, 0::INTEGER AS step, count(*) AS rows, 0::BIGINT AS next_id, 0::BIGINT AS orphans FROM region
UNION ALL SELECT 'nation', 1, count(*), max(n_nationkey) + 1, 0 FROM nation UNION ALL SELECT 'customer', 2, count(*), max(c_custkey) + 1, 0 FROM customer WHERE c_custkey % 11 <> 0
UNION ALL SELECT 'orders', 3, count(*), max(o_orderkey) + 1, count(*) FILTER (o_custkey % 11 = 0) FROM orders""",
    "markdown_lines": "SELECT 'n' || c_nationkey AS file, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos, 'C' || c_custkey || '/' || c_mktsegment AS cells FROM customer",
    "markdown_gangs": "SELECT s_name AS name, 'http://g' || s_suppkey || '.onion' AS url, CASE WHEN s_suppkey % 2 = 0 THEN 'ONLINE' ELSE 'OFFLINE' END AS status FROM supplier",
    "contact_kinds": "SELECT 'telegram' AS kind, count(*) AS n, count(*) AS values FROM customer UNION ALL SELECT 'email', count(*), count(*) FROM customer UNION ALL SELECT 'website', count(*), least(3, count(*)) FROM customer",
    "incremental_matches": "SELECT o_custkey % 40 AS watch_id, count(*) AS n FROM orders WHERE (o_custkey % 40 BETWEEN 20 AND 24 OR o_custkey % 40 < 20 AND o_orderkey % 10 = 1) AND o_orderkey % 100 <> 1 GROUP BY 1",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "structure_drift": "SELECT 'click' AS event_type, unnest(['$.k', '$.q']) AS path, unnest(['removed', 'added']) AS what",
    "unreachable_floors": "SELECT s_suppkey FROM supplier WHERE s_acctbal / 10000 < (s_suppkey % 10) / 10",
    "token_prices": "SELECT l_suppkey, round(sum(l_orderkey * 3.0 / 1000000 + l_partkey * 15.0 / 1000000), 3) AS spent FROM lineitem GROUP BY 1",
    "merged_aliases": "SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) || ',Zed' AS aliases FROM part GROUP BY 1",
    "software_groups": "SELECT DISTINCT s AS software, CAST(r AS INTEGER) AS r_regionkey FROM (SELECT ['REvil', 'sodinokibi ', 'Phobos'][p_partkey % 4 + 1] AS s, [0, 0, 1][p_partkey % 4 + 1] AS r FROM part WHERE p_partkey % 4 < 3)",
    "lowered_levels": "SELECT doc_id, CASE WHEN coalesce(contains(text, 'the '), false) THEN ['high', 'medium', 'low'][doc_id % 3 + 1] ELSE ['medium', 'low', 'low'][doc_id % 3 + 1] END AS level FROM documents",
}
