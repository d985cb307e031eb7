"""URL filters: rules first, and for what no rule decides the propagation of trust and distrust over the links between hosts.

1. Rules are looked up per distinct host: the host's suffixes meet the rules' hosts, so a page compares its path with the
   rules of its own host only. The longest rule that fits wins.
2. Hosts are linked by absolute links in the html, and in both directions with their parent host (``a.b.org`` and
   ``b.org``), down to two labels.
3. A host is a trusted seed by the share of its pages that rules allow, and a blocked seed by the share that they block.
   Personalised PageRank sends trust along the links; distrust goes against them, to those who link to blocked hosts.
4. A host is blocked if its distrust is ``FLOOR`` of a seed at least and over ``RATIO`` times its trust.

Scores are whole grains, divided without a rest, so a result doesn't depend on the order of additions, and SQL can state it.
Links are distinct per pair of hosts before they meet scores. They are written bucketed by host and lane, so that only
scores move in a round; a host with many links is dealt over lanes. A page whose host nobody knows is allowed.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and the verdict allow. Rules of equal
length can't fit one url unless they are equal; of equal ones block wins. Null html has no links; links of a host to
itself don't count. Rows that repeat a page_id are judged each for itself; a null page_id is kept. An empty table gives no rows. Urls and
pages of any length are taken whole. Columns besides page_id, url and html are not looked at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import ascii_lower, bounded
from cinderlake.session import shared_folder, written

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Grains of a whole seed; percent of a score that goes on; rounds; links of a host in one lane.
GRAINS, DAMPING, ROUNDS, LANE_LINKS = 1_000_000_000, 85, 20, 100_000
#: Blocked from this many grains on, and from this multiple of trust.
FLOOR, RATIO = 50_000_000, 3
#: Rounds between two written tables.
ROUNDS_AT_ONCE = 5
#: Host of an absolute link.
LINK = r"""[hH][rR][eE][fF][ \t\r\n]*=[ \t\r\n]*["']?[ \t\r\n]*(?:[hH][tT][tT][pP][sS]?:)?//([^/?#"' \t\r\n<>]+)"""


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def _suffixes(host: Column) -> Column:
    """The host and all hosts above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def judge_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, ruled`` for ``page_id, host, path``; ``rules`` has ``host, path, verdict``.

    Each host gets the list of the rules for it and the hosts above it, longest first.
    """
    name = F.concat("host", "path")
    known = rules.select(F.col("host").alias("_suffix"), F.struct((-F.length(name)).alias("order"), F.when(F.col("verdict") == "block", 0).otherwise(1).alias("mild"), name.alias("rule"), F.col("path").alias("start"), "verdict").alias("one"))
    hosts = pages.select("host").distinct().select(F.col("host").alias("_host"), F.explode(_suffixes(F.col("host"))).alias("_suffix"))
    lists = hosts.join(bounded(known), "_suffix").groupBy("_host").agg(F.array_sort(F.collect_list("one")).alias("rules"))
    both = pages.join(bounded(written(lists, "url-rules")), F.col("host") == F.col("_host"), "left")
    first = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["start"])), 0)
    return both.withColumn("first", first).select("page_id", "host", "path", F.col("first.rule").alias("rule"), F.col("first.verdict").alias("ruled"))


def host_links(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Distinct ``src, dst`` between different hosts: from ``host, html`` and between each of ``hosts`` and its parents."""
    linked = pages.where("host != ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("link"))
    linked = linked.select("src", ascii_lower(F.col("link")).alias("dst"))
    name = F.explode(F.filter(_suffixes(F.col("host")), lambda h: F.contains(h, F.lit(".")))).alias("src")
    named = hosts.union(linked.select("dst")).where(r"host rlike '[^0-9.:]'").distinct().select(name).distinct()
    up = named.select("src", F.expr("substr(src, instr(src, '.') + 1)").alias("dst")).where("instr(dst, '.') > 0")
    return linked.union(up).union(up.select("dst", "src")).where("src != dst").distinct()


def propagate(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``host, trust, distrust`` in grains, from ``host, trust, distrust`` of the seeds."""
    spark = links.sparkSession
    both = links.select(F.lit("trust").alias("kind"), "src", "dst").union(links.select(F.lit("distrust"), F.col("dst"), F.col("src")))
    degrees = both.groupBy("kind", F.col("src").alias("host")).agg(F.count(F.lit(1)).alias("degree"))
    degrees = written(degrees.withColumn("lanes", F.ceil(F.col("degree") / LANE_LINKS).cast("long")), "url-degrees")
    dealt = both.join(bounded(degrees.where("lanes > 1")).select("kind", F.col("host").alias("src"), "lanes"), ["kind", "src"], "left")
    dealt = dealt.select("kind", "src", F.coalesce(F.pmod(F.xxhash64("dst"), F.col("lanes")), F.lit(0)).cast("long").alias("lane"), "dst")
    buckets, name, path = int(spark.conf.get("spark.sql.shuffle.partitions")), f"links_{uuid.uuid4().hex}", shared_folder(spark, "url-links")
    key = ["kind", "src", "lane"]
    dealt.repartition(buckets, *key).write.option("compression", "zstd").option("path", path).bucketBy(buckets, *key).saveAsTable(name)
    ways = spark.table(name)
    ways.schema  # resolves the table while its name exists; the files stay
    spark.sql(f"DROP TABLE {name}")

    seeded = seeds.select("host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) AS (kind, seed)")).where("seed > 0")
    nodes = seeded.select("kind", "host", "seed", F.lit(0).cast("long").alias("degree"), F.lit(0).cast("long").alias("lanes"))
    nodes = nodes.union(degrees.select("kind", "host", F.lit(0).cast("long"), "degree", "lanes"))
    nodes = written(nodes.groupBy("kind", "host").agg(*[F.sum(c).alias(c) for c in ("seed", "degree", "lanes")]), "url-nodes")
    base = nodes.select("kind", "host", F.expr(f"seed * {100 - DAMPING} div 100").alias("score"), "degree", "lanes")
    scores = base
    for k in range(1, rounds + 1):
        share = scores.where("degree > 0").select("kind", F.col("host").alias("src"), F.expr(f"score div degree * {DAMPING} div 100").alias("share"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("lanes") - 1)).alias("lane"))
        sent = ways.join(share.where("share > 0"), key).select("kind", F.col("dst").alias("host"), F.col("share").alias("score"), F.lit(0).cast("long").alias("degree"), F.lit(0).cast("long").alias("lanes"))
        scores = base.union(sent).groupBy("kind", "host").agg(*[F.sum(c).alias(c) for c in ("score", "degree", "lanes")])
        if k % ROUNDS_AT_ONCE == 0 or k == rounds:
            scores = written(scores, "url-scores")
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0)).alias(kind)
    return scores.groupBy("host").agg(of("trust"), of("distrust"))


def judge_urls(pages: DataFrame, rules: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for ``page_id, url, html``; the scores are those of the host."""
    url = F.col("url").cast("string")
    rows = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"), F.col("html").cast("string").alias("html"))
    ruled = written(judge_rules(rows.select("page_id", "host", "path"), rules), "url-ruled")
    n = lambda verdict: F.sum((F.col("ruled") == verdict).cast("long"))
    hosts = ruled.where("host != ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.coalesce(n("allow"), F.lit(0)).alias("a"), F.coalesce(n("block"), F.lit(0)).alias("b"))
    hosts = written(hosts.select("host", F.expr(f"a * {GRAINS} div n").alias("trust"), F.expr(f"b * {GRAINS} div n").alias("distrust")), "url-hosts")
    links = written(host_links(rows.select("host", "html"), hosts.select("host")), "url-pairs")
    scores = propagate(links, hosts, rounds).select(F.col("host").alias("_host"), "trust", "distrust")
    out = ruled.join(bounded(written(scores, "url-final")), F.col("host") == F.col("_host"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0)).cast("long"), F.coalesce("distrust", F.lit(0)).cast("long")
    method = F.when((distrust >= FLOOR) & (distrust > RATIO * trust), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op11_url_filters(pages: DataFrame) -> DataFrame:
    """The contract's columns and the host's scores, with the contract's rules."""
    rules = pages.sparkSession.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(pages, rules)


def _oracle() -> str:
    """The same in SQL: as many tables of scores as rounds."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    link = LINK.replace("'", "''")
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"""
WITH RECURSIVE rules(h, p, v) AS (VALUES {values}),
u AS MATERIALIZED (SELECT row_number() OVER () AS n, page_id, html, {lower.format("coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '')")} AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*(/[^?#]*)', 1), '') AS path FROM pages),
f AS (SELECT n, h || p AS rule, v FROM u JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, v DESC) = 1),
j AS MATERIALIZED (SELECT u.*, rule, v FROM u LEFT JOIN f USING (n)),
s AS MATERIALIZED (SELECT host, count(*) FILTER (v = 'allow') * {GRAINS} // count(*) AS trust, count(*) FILTER (v = 'block') * {GRAINS} // count(*) AS distrust FROM j WHERE host <> '' GROUP BY host),
l AS (SELECT DISTINCT host AS src, {lower.format("unnest(regexp_extract_all(html, '" + link + "', 1))")} AS dst FROM u WHERE host <> ''),
up(h) AS (SELECT h FROM (SELECT host AS h FROM s UNION SELECT dst FROM l) WHERE regexp_matches(h, '[^0-9.:]') AND contains(h, '.') UNION SELECT substr(h, instr(h, '.') + 1) FROM up WHERE contains(substr(h, instr(h, '.') + 1), '.')),
q AS (SELECT h, substr(h, instr(h, '.') + 1) AS above FROM up WHERE contains(substr(h, instr(h, '.') + 1), '.')),
e AS (SELECT src, dst FROM l WHERE src <> dst UNION SELECT h, above FROM q UNION SELECT above, h FROM q),
w AS (SELECT 'trust' AS kind, src, dst FROM e UNION ALL SELECT 'distrust', dst, src FROM e),
ways AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY kind, src) AS degree FROM w),
base AS MATERIALIZED (SELECT 'trust' AS kind, host, trust * {100 - DAMPING} // 100 AS score FROM s UNION ALL SELECT 'distrust', host, distrust * {100 - DAMPING} // 100 FROM s),
r0 AS (SELECT * FROM base)"""
    for k in range(1, ROUNDS + 1):
        sent = f"SELECT w.kind, w.dst, r.score // w.degree * {DAMPING} // 100 FROM r{k - 1} r JOIN ways w ON w.kind = r.kind AND w.src = r.host"
        out += f",\nr{k} AS MATERIALIZED (SELECT kind, host, sum(score)::BIGINT AS score FROM (SELECT * FROM base UNION ALL {sent}) GROUP BY kind, host)"
    return out + f""",
t AS (SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0)::BIGINT AS trust, coalesce(sum(score) FILTER (kind = 'distrust'), 0)::BIGINT AS distrust FROM r{ROUNDS} GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(v, CASE WHEN distrust >= {FLOOR} AND distrust > {RATIO} * trust THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM j LEFT JOIN t USING (host)
"""


ORACLE = _oracle()
