"""What leaves the system: STIX bundles, notification events, vector caches."""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.operators.scoring import lookup

#: Namespace of deterministic ids and marking definitions, as the specifications assign them.
NAMESPACE = "00abedb4-aa42-466c-9c01-fed23315a9b7"
MARKINGS = {
    "clear": "marking-definition--94868c89-83c2-464b-929b-a1a8aa3c8487",
    "green": "marking-definition--bab4a63c-aed9-4cf5-a766-dfca5abac2bb",
    "amber": "marking-definition--55d920b0-5e8b-4f79-9ee9-91f868d9b421",
    "amber+strict": "marking-definition--939a9414-2ddd-4d32-a0cd-375ea402b003",
    "red": "marking-definition--e828b379-4e03-4974-9ac4-e53a884c97c1",
}


def uuid5(namespace: str, name: Column) -> Column:
    """Version 5 UUID: the SHA-1 of namespace and name with the version's bits set. Native."""
    h = F.sha1(F.concat(F.unhex(F.lit(uuid.UUID(namespace).hex)), name.cast("binary")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def object_id(kind: str, key: Column) -> Column:
    """``kind--uuid`` of an object."""
    return F.concat(F.lit(f"{kind}--"), uuid5(NAMESPACE, F.concat(F.lit(f"{kind}:"), key)))


def stix_objects(groups: DataFrame, techniques: DataFrame, tools: DataFrame, created: str, tlp: str = "clear") -> DataFrame:
    """``group_id, ordinal, id, json``: objects of each group's bundle, each id once, nulls left out.

    groups: group_id, name, description, aliases (array); techniques: group_id, technique_id, technique_name;
    tools: group_id, tool_name.
    """
    stamp = F.date_format(F.lit(created).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    marking = F.array(lookup(MARKINGS, F.lit(tlp)))
    intrusion = object_id("intrusion-set", F.lower("name"))
    head = groups.select("group_id", intrusion.alias("_g"), "name", "description", "aliases")

    def objects(rows: DataFrame, ordinal: int, kind: str, key: Column, **fields: Column) -> DataFrame:
        body = F.struct(
            F.lit(kind).alias("type"), F.lit("2.1").alias("spec_version"), key.alias("id"), stamp.alias("created"), stamp.alias("modified"),
            *[c.alias(n) for n, c in fields.items()], marking.alias("object_marking_refs"),
        )
        return rows.select("group_id", F.lit(ordinal).alias("ordinal"), key.alias("id"), F.to_json(body).alias("json"))

    own = F.when(F.size("aliases") > 0, F.col("aliases"))
    out = objects(head, 0, "intrusion-set", F.col("_g"), name=F.col("name"), description=F.nullif(F.substring("description", 1, 5000), F.lit("")), aliases=own)
    t = techniques.join(head.select("group_id", "_g"), "group_id").withColumn("_t", object_id("attack-pattern", F.col("technique_id")))
    url = F.concat(F.lit("https://attack.mitre.org/techniques/"), F.translate("technique_id", ".", "/"), F.lit("/"))
    ref = F.array(F.struct(F.lit("mitre-attack").alias("source_name"), F.col("technique_id").alias("external_id"), url.alias("url")))
    x = tools.where("tool_name <> ''").join(head.select("group_id", "_g"), "group_id").withColumn("_t", object_id("tool", F.lower("tool_name")))
    uses = lambda rows, n: objects(rows, n, "relationship", object_id("relationship", F.concat("_g", F.lit("|uses|"), "_t")), relationship_type=F.lit("uses"), source_ref=F.col("_g"), target_ref=F.col("_t"))
    out = out.unionByName(objects(t, 1, "attack-pattern", F.col("_t"), name=F.col("technique_name"), external_references=ref)).unionByName(uses(t, 2))
    out = out.unionByName(objects(x, 3, "tool", F.col("_t"), name=F.col("tool_name"))).unionByName(uses(x, 4))
    return out.groupBy("group_id", "id").agg(F.min(F.struct("ordinal", "json")).alias("b")).select("group_id", "b.ordinal", "id", "b.json")


def stix_bundles(objects: DataFrame) -> DataFrame:
    """``group_id, bundle``: one JSON text per group; the id comes from the objects' ids, so it repeats."""
    held = objects.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "id", "json"))).alias("o"))
    key = F.sha2(F.array_join(F.transform("o", lambda x: x["id"]), ","), 256)
    body = F.array_join(F.transform("o", lambda x: x["json"]), ",")
    return held.select("group_id", F.concat(F.lit('{"type":"bundle","id":"'), object_id("bundle", key), F.lit('","objects":['), body, F.lit("]}")).alias("bundle"))


def events_of(alerts: DataFrame, watch: DataFrame, victims: DataFrame, groups: DataFrame) -> DataFrame:
    """Alerts with what a channel needs; alerts without their watch entry or victim are dropped."""
    return alerts.join(watch, "watch_id").join(victims, "victim_id").join(groups, "group_id", "left")


def event_batches(events: DataFrame, size: int, order: str) -> DataFrame:
    """``batch, payload``: JSON ``{"events": [...]}`` of at most ``size`` events."""
    numbered = events.withColumn("_b", F.floor(F.col(order) / size))
    held = numbered.groupBy(F.col("_b").alias("batch")).agg(F.array_sort(F.collect_list(F.struct(F.col(order), *[c for c in events.columns if c != order]))).alias("events"))
    return held.select("batch", F.to_json(F.struct("events")).alias("payload"))


def stub_vector(text: str, width: int = 64) -> list[float]:
    """Deterministic unit vector from digests of a text."""
    import numpy as np

    need = -(-width // 32)
    raw = b"".join(hashlib.sha256(text.encode() + k.to_bytes(4, "big")).digest() for k in range(need))
    v = np.frombuffer(raw, np.uint8)[:width] / 255.0 - 0.5
    return (v / max(float(np.linalg.norm(v)), 1e-12)).astype("float32").tolist()


def encode_missing(docs: DataFrame, text: str, cache: DataFrame, model: str, encode=stub_vector) -> tuple[DataFrame, DataFrame]:
    """Documents with ``vector``, and the rows to append to the cache (model, key, vector): each new text is encoded once."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(encode)

    keyed = docs.withColumn("key", F.sha2(F.coalesce(text, F.lit("")), 256))
    own = cache.where(F.col("model") == model).select("key", "vector")
    new = keyed.select("key", F.coalesce(text, F.lit("")).alias("_t")).join(own, "key", "left_anti").groupBy("key").agg(F.max("_t").alias("_t"))
    fresh = new.select(F.lit(model).alias("model"), "key", F.pandas_udf(run, "array<float>")("_t").alias("vector"))
    return keyed.join(own.unionByName(fresh.drop("model")), "key"), fresh


def prompt_print(version: Column, system: Column) -> Column:
    """Version and the first eight digits of the text's digest."""
    return F.concat_ws("+", version, F.substring(F.sha2(system, 256), 1, 8))


def flag(code: Column) -> Column:
    """Two letters as regional indicators."""
    letters = F.array(*[F.lit(chr(0x1F1E6 + k)) for k in range(26)])
    one = lambda n: F.try_element_at(letters, (F.ascii(F.substring(F.upper(code), n, 1)) - 64).cast("int"))
    return F.when(F.upper(code).rlike("^[A-Z]{2}$"), F.concat(one(1), one(2))).otherwise("")
