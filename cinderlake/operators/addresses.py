"""Addresses in published ranges. Both versions are compared as 32 hex digits, since 128 bits exceed a decimal."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.operators.sweep import covered_points, merged_spans

_BYTE = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: An address of version 4, alone or as a block.
_PLAIN = rf"^[ \t]*{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}(?:/(3[0-2]|[12]?\d))?[ \t]*$"


def _span(entry) -> tuple:
    """Version and ends of an address, block or span; nulls if it can't be read."""
    try:
        text = str(entry).strip()
        if "-" in text:
            a, b = (ipaddress.ip_address(x.strip()) for x in text.split("-", 1))
        else:
            net = ipaddress.ip_network(text, strict=False)
            a, b = net[0], net[-1]
        if a.version != b.version or a > b:
            return None, None, None
        return a.version, f"{int(a):032x}", f"{int(b):032x}"
    except ValueError:
        return None, None, None


def span(entry: Column) -> Column:
    """``version, lo, hi`` of an address, CIDR block or first-last span. Plain ones of version 4 don't pass through Python."""

    def run(entries: pd.Series) -> pd.DataFrame:
        none = (None, None, None)
        return pd.DataFrame([none if e is None else _span(e) for e in entries], columns=["version", "lo", "hi"]).astype({"version": "Int32"})

    kind = "struct<version:int,lo:string,hi:string>"
    part = lambda k: F.regexp_extract(entry, _PLAIN, k)
    bits = F.coalesce(F.nullif(part(5), F.lit("")).try_cast("int"), F.lit(32))
    number = sum((part(k).try_cast("long") * (1 << 8 * (4 - k)) for k in range(2, 5)), part(1).try_cast("long") * (1 << 24))
    wide = F.call_function("shiftleft", F.lit(1).cast("long"), 32 - bits)
    hexed = lambda x: F.lpad(F.lower(F.hex(x)), 32, "0")

    def ends(x: Column) -> Column:
        lo = x["n"] - F.pmod(x["n"], x["w"])
        return F.struct(F.lit(4).alias("version"), hexed(lo).alias("lo"), hexed(lo + x["w"] - 1).alias("hi"))

    plain = F.coalesce(entry.rlike(_PLAIN), F.lit(False))
    native = F.get(F.transform(F.array(F.struct(number.alias("n"), wide.alias("w"))), ends), F.lit(0)).cast(kind)
    other = F.pandas_udf(run, "version int, lo string, hi string")(F.when(~plain, entry))
    return F.when(plain, native).otherwise(other.cast(kind))


def covered(points: DataFrame, at: str, spans: DataFrame) -> DataFrame:
    """Points with ``covered``: whether any span (version, lo, hi) has their address."""
    p = points.withColumn("_s", span(F.col(at))).withColumn("_v", F.col("_s.version")).withColumn("_x", F.col("_s.lo")).drop("_s")
    s = spans.select(F.col("version").alias("_v"), "lo", "hi")
    hit = covered_points(p.select("_v", "_x"), s, ["_v"], "_x", "lo", "hi").withColumn("_hit", F.lit(True))
    return p.join(hit, ["_v", "_x"], "left").withColumn("covered", F.coalesce("_hit", F.lit(False))).drop("_v", "_x", "_hit")


def merged(spans: DataFrame) -> DataFrame:
    """``version, lo, hi``: overlapping spans put together."""
    return merged_spans(spans.select("version", "lo", "hi"), ["version"], "lo", "hi")
