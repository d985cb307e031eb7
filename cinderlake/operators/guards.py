"""Small rules around reading and writing: roles, pages, public addresses, details, locations, baselines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.session import shared_folder

#: Roles from least to most.
ROLES = ("viewer", "analyst", "admin")


def role_at_least(role: Column, least: Column) -> Column:
    """Whether a role is another or more; unknown roles are less than all."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, ROLES)), c)
    return (rank(role) >= rank(least)) & (rank(least) > 0)


def may_leave(users: DataFrame, user: str) -> DataFrame:
    """``user, may_leave``: the last active admin (role, active) can't be demoted or deleted."""
    admins = users.agg(F.count_if((F.col("role") == "admin") & F.col("active")).alias("_n"))
    own = (F.col("role") == "admin") & F.col("active")
    return users.crossJoin(F.broadcast(admins)).select(user, (~own | (F.col("_n") > 1)).alias("may_leave"))


def page_then_filter(rows: DataFrame, order: list, page: int, size: int, keep: Column) -> DataFrame:
    """One page, filtered after it was cut: fewer rows than a page, while totals count all rows."""
    return rows.orderBy(*order).offset((page - 1) * size).limit(size).where(keep)


def newest_with_body(rows: DataFrame, body: str, when: str, id_col: str) -> DataFrame:
    """The newest row that has a body; rows without time come last."""
    return rows.where(F.coalesce(F.col(body), F.lit("")) != "").orderBy(F.desc_nulls_last(when), F.desc(id_col)).limit(1)


def public_url(url: Column) -> Column:
    """Whether a URL may be called: http or https, a host, and no loopback, private, local, reserved or multicast address."""
    def one(u: str) -> bool:
        import ipaddress
        from urllib.parse import urlparse

        try:
            parts = urlparse(u)
            name = parts.hostname
        except ValueError:
            return False
        if parts.scheme not in ("http", "https") or not name or name == "localhost":
            return False
        try:
            ip = ipaddress.ip_address(name)
        except ValueError:
            return True
        return not any((ip.is_private, ip.is_loopback, ip.is_link_local, ip.is_reserved, ip.is_multicast))

    def run(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: bool(u) and one(u))

    return F.pandas_udf(run, "boolean")(url)


def detail(payload: Column, schema: str) -> Column:
    """A landed detail as a struct: an object, or the first of a list of them; null for anything else."""
    bare = F.trim(payload)
    first = F.from_json(bare, f"array<{schema}>")[0]
    return F.when(bare.startswith("["), first).when(bare.startswith("{"), F.from_json(bare, schema))


def upsert_locations(current: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Locations (group_id, fqdn, available) after a feed, and what changed (group_id, fqdn, change).

    A location is inserted once; of known ones only those are written whose availability differs.
    """
    keys = ["group_id", "fqdn"]
    once = new.groupBy(*keys).agg(F.max("available").alias("_new"))
    both = current.join(once, keys, "full")
    change = F.when(F.col("available").isNull(), "inserted").when(F.col("_new").isNotNull() & (F.col("_new") != F.col("available")), "updated")
    changes = both.select(*keys, change.alias("change")).where("change IS NOT NULL")
    return both.select(*keys, F.coalesce("_new", "available").alias("available")), changes


def append_contacts(current: DataFrame, new: DataFrame) -> DataFrame:
    """Contacts (group_id, kind, value) with the new ones that no spelling of is there."""
    keys = [F.col("group_id"), F.col("kind"), F.lower("value").alias("_v")]
    fresh = new.groupBy(*keys).agg(F.min("value").alias("value")).join(current.select(*keys).distinct(), ["group_id", "kind", "_v"], "left_anti")
    return current.unionByName(fresh.drop("_v"))


def poll(spark: SparkSession, feeds: dict[str, str], read) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """What the feeds (name to path) hold, each with its name, and a status per feed: a feed that can't be read costs no other.

    ``read(spark, path)`` gives a DataFrame; a feed is read when it is counted.
    """
    out, status = None, []
    for name in sorted(feeds):
        try:
            rows = read(spark, feeds[name]).withColumn("feed", F.lit(name))
            n = rows.count()
        except Exception as e:  # whatever a feed fails of is its own
            status.append((name, type(e).__name__))
            continue
        status.append((name, f"ok {n}"))
        out = rows if out is None else out.unionByName(rows)
    return out, status


def polled(feeds: DataFrame, texts: DataFrame, entry: str) -> tuple[DataFrame, DataFrame]:
    """Entries (feed and the fields of ``entry``) of all enabled feeds, and a status per feed, each as one plan over all feeds.

    ``feeds`` has (feed, enabled), ``texts`` what they landed as (feed, value), a JSON array per row. A text that can't be read costs no
    other. Status (feed, status, texts, unreadable, entries): off, missing (nothing landed), unreadable (no text can be read) or ok.
    """
    on = feeds.where("enabled").select("feed").distinct()
    read = texts.select("feed", F.from_json("value", f"array<{entry}>").alias("_e")).join(on, "feed", "left_semi")
    tally = read.groupBy("feed").agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("_e").isNull()).alias("unreadable"), F.coalesce(F.sum(F.size("_e")), F.lit(0)).alias("entries"))
    state = F.when(~F.coalesce("enabled", F.lit(False)), "off").when(F.col("texts").isNull(), "missing").when(F.col("texts") == F.col("unreadable"), "unreadable").otherwise("ok")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("texts", "unreadable", "entries")]
    status = feeds.groupBy("feed").agg(F.max("enabled").alias("enabled")).join(tally, "feed", "left").select("feed", state.alias("status"), *numbers)
    return read.select("feed", F.inline("_e")), status


def run_named(jobs: dict, names: list[str], *args) -> tuple[dict, list[str]]:
    """Results of the jobs in the order of ``names``, and names that nothing is registered under."""
    return {n: jobs[n](*args) for n in names if n in jobs}, [n for n in names if n not in jobs]


def save_baseline(structures: DataFrame, name: str, structure: str) -> str:
    """Structures by name as one JSON text each, keys in order; the path they can be read from."""
    path = shared_folder(structures.sparkSession, "baseline")
    structures.select(F.to_json(F.struct(F.col(name).alias("name"), F.col(structure).alias("structure"))).alias("value")).write.text(path)
    return path


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """``name, structure`` of a saved baseline."""
    return spark.read.text(path).select(F.from_json("value", "name string, structure string").alias("b")).select("b.*")
