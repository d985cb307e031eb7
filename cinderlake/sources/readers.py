"""Readers of landed feeds. Schemas are declared; what doesn't fit is kept apart, not guessed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.functions.text import timestamp

VICTIM = "victim string, group_name string, attackdate string, discovered string, domain string, country string, description string, activity string, url string"
GROUP = "name string, altname string, description string, type string, locations array<struct<slug:string,fqdn:string,title:string,available:boolean,enabled:boolean>>"
ATTACK = "victim string, date string, attack_date string, country string, title string, url string, summary string, domain string"
PAYMENT = "address string, family string, balance long, transactions array<struct<hash:string,time:long,amount:long,amountUSD:double>>"
BUNDLE = """objects array<struct<type:string,id:string,name:string,description:string,aliases:array<string>,revoked:boolean,x_mitre_deprecated:boolean,modified:string,
relationship_type:string,source_ref:string,target_ref:string,kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>,
external_references:array<struct<source_name:string,external_id:string,url:string>>>>"""

#: Networks whose addresses are rented out by the hour.
HOSTING_ASNS = (9009, 60068, 212238, 136787, 16509, 14618, 15169, 396982, 8075, 13335, 45102, 132203, 14061, 16276, 24940, 20473, 63949, 51167, 62240, 9370)


class FeedMissingError(Exception):
    """A feed that isn't there: not the same as one that has no rows."""


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def landed_json(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """JSON files by a declared schema; raises if there are none, keeps unreadable records in ``_corrupt``."""
    if not _exists(spark, path):
        raise FeedMissingError(path)
    return spark.read.schema(schema + ", _corrupt string").option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def victims(spark: SparkSession, path: str) -> DataFrame:
    """Victims with empty texts for missing names and parsed times; ``year`` partitions are discovered."""
    raw = landed_json(spark, path, VICTIM)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return raw.where("_corrupt IS NULL").select(F.coalesce("victim", F.lit("")).alias("victim_name"), text("group_name"), F.nullif(F.col("domain"), F.lit("")).alias("domain"), F.upper("country").alias("country"), "description", "activity", "url", timestamp(F.col("attackdate")).alias("attackdate"), timestamp(F.col("discovered")).alias("discovered"))


def groups(spark: SparkSession, path: str) -> DataFrame:
    """Groups with their locations; falsy values become nulls or empty arrays."""
    raw = landed_json(spark, path, GROUP)
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")).alias(c)
    return raw.where("_corrupt IS NULL").select(blank("name"), blank("altname"), blank("description"), blank("type"), F.coalesce("locations", F.array().cast("array<struct<slug:string,fqdn:string,title:string,available:boolean,enabled:boolean>>")).alias("locations"))


def attacks(spark: SparkSession, path: str) -> DataFrame:
    """Attacks; the date is ``date`` or, where empty, ``attack_date``."""
    raw = landed_json(spark, path, ATTACK)
    when = F.coalesce(F.nullif(F.col("date"), F.lit("")), F.col("attack_date"))
    return raw.where("_corrupt IS NULL").select(F.coalesce("victim", F.lit("")).alias("victim_name"), timestamp(when).alias("attack_date"), F.upper("country").alias("country"), "title", "url", "summary", "domain")


def payments(spark: SparkSession, path: str) -> DataFrame:
    """One row per transaction from a bare list or ``{"result": [...]}``; first of (address, hash); satoshis become coins."""
    if not _exists(spark, path):
        raise FeedMissingError(path)
    entry = f"struct<{', '.join(c.strip().replace(' ', ':', 1) for c in PAYMENT.split(', '))}>"
    whole = spark.read.text(path, wholetext=True).select(F.coalesce(F.from_json("value", f"struct<result:array<{entry}>>")["result"], F.from_json("value", f"array<{entry}>")).alias("r"))
    tx = whole.select(F.explode("r").alias("r")).select("r.address", "r.family", F.posexplode("r.transactions").alias("pos", "t")).select("address", "family", "pos", "t.*")
    rest = F.struct("family", "time", "amount", "amountUSD")
    best = tx.groupBy("address", "hash").agg(F.min_by(rest, "pos").alias("b"))
    return best.select("address", "hash", "b.family", F.timestamp_seconds("b.time").alias("at"), (F.col("b.amount").cast("decimal(20,0)") / F.lit(100_000_000).cast("decimal(20,0)")).cast("decimal(18,8)").alias("btc"), F.col("b.amountUSD").cast("decimal(14,2)").alias("usd"))


def bundle(spark: SparkSession, path: str) -> DataFrame:
    """Objects of a STIX bundle."""
    raw = landed_json(spark, path, BUNDLE)
    return raw.where("objects IS NOT NULL").select(F.explode("objects").alias("o")).select("o.*")


def bundle_nodes(objects: DataFrame) -> DataFrame:
    """``id, kind, external_id, name, aliases, description, tactics``; revoked and deprecated ones go."""
    kinds = F.create_map(*[F.lit(x) for kv in {"intrusion-set": "group", "attack-pattern": "technique", "malware": "software", "tool": "software"}.items() for x in kv])
    live = objects.where("NOT coalesce(revoked, false) AND NOT coalesce(x_mitre_deprecated, false)").withColumn("kind", F.try_element_at(kinds, F.col("type"))).where("kind IS NOT NULL")
    ext = F.filter("external_references", lambda r: r["source_name"] == "mitre-attack")
    return live.select("id", "kind", F.try_element_at(ext, F.lit(1))["external_id"].alias("external_id"), "name", "aliases", "description", F.transform("kill_chain_phases", lambda p: p["phase_name"]).alias("tactics"), timestamp(F.col("modified")).alias("modified"))


def bundle_edges(objects: DataFrame, kind: str = "uses") -> DataFrame:
    """``src, dst`` of relationships of a kind."""
    return objects.where((F.col("type") == "relationship") & (F.col("relationship_type") == kind) & ~F.coalesce("revoked", F.lit(False))).select(F.col("source_ref").alias("src"), F.col("target_ref").alias("dst"))


def modified_since(nodes: DataFrame, since: str) -> DataFrame:
    """Nodes changed after a time; those without a readable time stay."""
    return nodes.where(F.col("modified").isNull() | (F.col("modified") > F.lit(since).cast("timestamp")))


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """RSS items and Atom entries: title, link, summary, published."""
    if not _exists(spark, path):
        raise FeedMissingError(path)
    rss = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, pubDate string").load(path)
    atom = spark.read.format("xml").option("rowTag", "entry").schema("title string, link struct<_href:string>, summary string, published string, updated string").load(path)
    when = timestamp(F.col("pubDate"))
    parsed = F.coalesce(F.try_to_timestamp(F.regexp_replace("pubDate", r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")), when)
    one = rss.where("title IS NOT NULL OR link IS NOT NULL").select("title", F.trim("link").alias("link"), F.col("description").alias("summary"), parsed.alias("published"))
    two = atom.where("title IS NOT NULL").select("title", F.col("link._href").alias("link"), "summary", timestamp(F.coalesce("published", "updated")).alias("published"))
    return one.unionByName(two)


def asn_spans(spark: SparkSession, path: str, asns: tuple = HOSTING_ASNS) -> DataFrame:
    """``first, last`` of the given networks from a tab-separated file, gzipped or not."""
    if not _exists(spark, path):
        raise FeedMissingError(path)
    raw = spark.read.schema("first string, last string, asn string, country string, name string").option("sep", "\t").option("quote", "").csv(path)
    return raw.where(F.expr("try_cast(asn AS int)").isin(*asns)).select("first", "last")


def exit_addresses(spark: SparkSession, path: str) -> DataFrame:
    """Addresses of the lines that begin with ExitAddress."""
    if not _exists(spark, path):
        raise FeedMissingError(path)
    return spark.read.text(path).where(F.col("value").startswith("ExitAddress ")).select(F.split_part("value", F.lit(" "), F.lit(2)).alias("address")).where("address <> ''")


def column_of(spark: SparkSession, path: str, column: int) -> DataFrame:
    """n-th comma-separated field, without the first line of a file and lines of merge conflicts."""
    if not _exists(spark, path):
        raise FeedMissingError(path)
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("no", "line")).where("no > 0")
    kept = lines.where(~F.substring("line", 1, 1).isin("<", "=", ">") & (F.size(F.split("line", ",")) > column))
    return kept.select(F.trim(F.split("line", ",")[column]).alias("address")).where("address <> ''")


def copy_table(source: DataFrame, target_columns: list[str]) -> DataFrame:
    """Columns that both sides have, in the order of the target: what a copy between databases writes."""
    return source.select(*[c for c in target_columns if c in source.columns])
