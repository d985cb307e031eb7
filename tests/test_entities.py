import json
import uuid

from pyspark.sql import functions as F

from cinderlake.operators import addresses as N
from cinderlake.operators import exports as E
from cinderlake.operators import identity as D
from cinderlake.operators import scoring as S


def one(spark, expr, values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"c {kind}").select(expr.alias("x")).collect()]


def test_uuid5(spark):
    names = ["intrusion-set:lockbit", "tool:é", ""]
    assert one(spark, E.uuid5(E.NAMESPACE, F.col("c")), names) == [str(uuid.uuid5(uuid.UUID(E.NAMESPACE), n)) for n in names]


def test_bundle(spark):
    groups = spark.createDataFrame([(1, "Acme", "", []), (2, "Beta", "d", ["b"])], "group_id int, name string, description string, aliases array<string>")
    techniques = spark.createDataFrame([(1, "T1.001", "x"), (1, "T1.001", "x")], "group_id int, technique_id string, technique_name string")
    tools = spark.createDataFrame([(1, "Tool"), (2, "")], "group_id int, tool_name string")
    got = {r["group_id"]: json.loads(r["bundle"]) for r in E.stix_bundles(E.stix_objects(groups, techniques, tools, "2024-01-01", "red")).collect()}
    kinds = [o["type"] for o in got[1]["objects"]]
    assert kinds == ["intrusion-set", "attack-pattern", "relationship", "tool", "relationship"] and len(got[2]["objects"]) == 1
    head = got[1]["objects"][0]
    assert "description" not in head and "aliases" not in head and got[2]["objects"][0]["aliases"] == ["b"]
    assert got[1]["objects"][1]["external_references"][0]["url"] == "https://attack.mitre.org/techniques/T1/001/"
    assert got[1]["objects"][2]["target_ref"] == got[1]["objects"][1]["id"] and head["object_marking_refs"] == [E.MARKINGS["red"]]


def test_identity(spark):
    c = F.col("c")
    assert one(spark, D.designator(c), ["Storm-0501", "UNC 2452", "TA505", "Lazarus", "CL-STA-0240"]) == ["Microsoft", "Mandiant", "Proofpoint", "", "Unit 42"]
    scheme = one(spark, D.naming_scheme(c), ["Fancy Bear", "Fox Tempest", "IRON Twilight", "Bear", "Some Name"])
    assert [tuple(x) if x else None for x in scheme] == [("CrowdStrike", "Russia"), ("Microsoft", "financially motivated"), ("Secureworks", "Russia"), None, None]
    assert one(spark, D.country_of(c), ["a Chinese group in Russia", "from Ukraine", "north korea"]) == ["RU", None, "KP"]


def test_resolution(spark):
    entries = spark.createDataFrame([(1, 0, "Second", "b", ["APT 29"]), (0, 5, "First", "a", ["APT29", "Cozy Bear"])], "precedence int, ordinal int, canonical string, authority string, names array<string>")
    keys = D.catalogue(entries)
    other = spark.createDataFrame([("emotet", "Emotet")], "key string, canonical string")
    names = spark.createDataFrame([("apt29",), ("Cozy Bear Team",), ("EMOTET",), ("UNC1234",), ("Fox Tempest",), ("who",)], "n string")
    got = {r["name"]: (r["kind"], r["canonical"]) for r in D.resolve_identity(names, "n", keys, other, other.where("false")).collect()}
    assert got == {"apt29": ("known_actor", "First"), "Cozy Bear Team": ("known_actor", "First"), "EMOTET": ("malware", "Emotet"), "UNC1234": ("cluster_designator", None), "Fox Tempest": ("vendor_named", None), "who": ("unknown", None)}


def test_addresses(spark):
    spans = spark.createDataFrame([(x,) for x in ("10.0.0.0/8", "1.2.3.4", "5.0.0.10-5.0.1.20", "2001:db8::/32", "bad", "9.0.0.2-9.0.0.1")], "e string").select(N.span(F.col("e")).alias("s")).select("s.*")
    points = ["10.200.3.4", "1.2.3.4", "1.2.3.5", "5.0.1.0", "5.0.1.21", "2001:db8:1::5", "2001:db9::1", "junk"]
    got = {r["a"]: r["covered"] for r in N.covered(spark.createDataFrame([(p,) for p in points], "a string"), "a", spans).collect()}
    assert got == {"10.200.3.4": True, "1.2.3.4": True, "1.2.3.5": False, "5.0.1.0": True, "5.0.1.21": False, "2001:db8:1::5": True, "2001:db9::1": False, "junk": False}


def test_vectors(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id int, t string")
    none = spark.createDataFrame([], "model string, key string, vector array<float>")
    full, fresh = E.encode_missing(docs, "t", none, "m")
    assert full.count() == 4 and fresh.count() == 3
    _, again = E.encode_missing(docs, "t", fresh, "m")
    assert again.count() == 0


def test_levels(spark):
    rows = spark.createDataFrame([("a", "green"), ("a", "AMBER"), ("b", None), ("c", "clear")], "s string, t string")
    assert {r["s"]: r["tlp"] for r in S.most_restrictive(rows, ["s"], "t").collect()} == {"a": "amber", "b": "amber+strict", "c": "clear"}
    assert one(spark, E.flag(F.col("c")), ["us", "x", None]) == ["\U0001f1fa\U0001f1f8", "", ""]


def test_address_cover_beyond_24_bits(spark, tmp_path):
    """Keys of larger tables go past the end of 10.0.0.0/8: query and SQL begin anew there, and a span over the end is none."""
    import duckdb

    from cinderlake.plans import entities

    suppliers = [(k, k % 30) for k in [*range(1, 60), *range(23900, 23960), 60000]]
    keys = {(k * 701 + d) % (1 << 24) * pow(37, -1, 1 << 24) % (1 << 24) for k, _ in suppliers for d in (-300, -1, 0, 1, 255, 999, 1000)}
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k, c) for k, c in enumerate(sorted(keys))], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {tuple(r) for r in entities.address_cover(spark, str(tmp_path)).collect()}
    for t in ("supplier", "orders"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == set(duckdb.sql(entities.ORACLES["address_cover"]).fetchall())
    assert 0 < sum(c for _, c in got) < len(got)


def test_tactic_matrix_in_bounded_tasks(spark, tmp_path, monkeypatch):
    """More lines are dealt to more tasks before anything is counted; rows equal the SQL, nulls included."""
    import duckdb

    from cinderlake.plans import entities

    monkeypatch.setattr(entities, "TASK_LINES", 100)
    lines = [(k * 7 % 90, k * k % 40 if k % 11 else None, k % 7 + 1) for k in range(2000)] + [(None, 3, 1), (None, None, 2)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = entities.tactic_matrix(spark, str(tmp_path))
    got = {tuple(r) for r in out.collect()}
    duckdb.sql(f"CREATE OR REPLACE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == set(duckdb.sql(entities.ORACLES["tactic_matrix"]).fetchall()) and len(got) == 7
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [l_partkey" in plan and ", 21" in plan
