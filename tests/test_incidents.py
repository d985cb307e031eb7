"""The data source over landed folders."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cinderlake.sources import incidents as S


@pytest.fixture
def landed(tmp_path):
    def put(folder, name, data):
        os.makedirs(tmp_path / folder, exist_ok=True)
        (tmp_path / folder / name).write_text(data if isinstance(data, str) else json.dumps(data))

    for year in (2022, 2023, 2024):
        for month in (1, 2, 11):
            put(f"leaks/victims_history/year={year}/month={month}", "a.json", [{"victim": f"v{year}", "group_name": "g", "country": month}, {"post_title": "t", "extra": 1}, "no object"])
    put("leaks/victims_history/year=soon/month=1", "a.json", "not JSON")
    put("leaks/victims_history/year=1999/month=1", "broken.json", "not JSON")
    put("leaks/victims", "a.json", {"victim": "one", "description": {"a": [1, "é"]}})
    put("leaks/attacks", "a.json", [{"victim": "x", "date": "", "attack_date": "2024-01-02"}, {"victim": "y", "date": "2024-03-04", "attack_date": "z"}])
    put("wallets/groups", "a.json", {"result": [{"family": "f", "type": 3}]})
    put("wallets/attacks", "b.json", [{"victim_name": "w"}])
    os.makedirs(tmp_path / "wallets/victims")
    return str(tmp_path)


def test_only_wanted_years_are_opened(spark, landed):
    """The year with a broken file is neither listed nor opened unless it is asked for."""
    some = S.feed(spark, landed, "leaks", "victims_history", years="2023-2024", months="1,11")
    assert some.rdd.getNumPartitions() == 4
    assert sorted((r["victim_name"], r["year"], r["month"]) for r in some.collect()) == sorted((v, y, m) for y in (2023, 2024) for m in (1, 11) for v in (f"v{y}", "t"))
    with pytest.raises(Exception, match="not JSON"):
        S.feed(spark, landed, "leaks", "victims_history").where("year = 2022").count()
    bad = S.feed(spark, landed, "leaks", "victims_history", mode="PERMISSIVE").where("_corrupt IS NOT NULL").collect()
    assert [(r["year"], r["_corrupt"].endswith("broken.json")) for r in bad] == [(1999, True)]
    assert S.feed(spark, landed, "leaks", "victims_history", years="1850").count() == 0


def test_pushed_filters(spark, landed):
    """Filters choose folders in a table that is loaded for one scan."""
    load = lambda: S.feed(spark, landed, "leaks", "victims_history", pushdown=True)
    assert load().where("year >= 2023 AND month IN (1, 11)").rdd.getNumPartitions() == 4
    assert load().where("year = 2022 AND month < 2").rdd.getNumPartitions() == 1
    assert load().where((F.col("year") == 2022) & (F.col("country") == "11")).count() == 1
    assert load().where("year IS NOT NULL AND year > 2021 AND NOT month = 1").count() == 12
    assert load().where("year < 1900").count() == 0


def test_one_table_in_two_scans(spark, landed):
    """Without that option a table may be scanned as often as one likes."""
    df = S.feed(spark, landed, "leaks", "victims_history", years="2022-2024")
    both = df.where("year = 2022").union(df.where("year = 2023"))
    assert sorted({r["year"] for r in both.collect()}) == [2022, 2023] and df.count() == 18
    assert df.where("year = 2022").select("month").join(df.where("year = 2024").select("month"), "month").count() == 12


def test_contract(spark, landed):
    one = S.feed(spark, landed, "leaks", "victims").collect()
    assert [(r["victim_name"], json.loads(r["description"]), r["year"]) for r in one] == [("one", {"a": [1, "é"]}, None)]
    assert sorted((r["victim_name"], r["attack_date"]) for r in S.feed(spark, landed, "leaks", "attacks").collect()) == [("x", "2024-01-02"), ("y", "2024-03-04")]
    assert [(r["name"], r["type"]) for r in S.feed(spark, landed, "wallets", "groups").collect()] == [("f", "3")]
    # a source without history: none of victims, and the present attacks
    assert S.feed(spark, landed, "wallets", "victims_history").count() == 0 and S.feed(spark, landed, "wallets", "victims").count() == 0
    assert [r["victim_name"] for r in S.feed(spark, landed, "wallets", "attacks_history").collect()] == ["w"]
    assert S.feed(spark, landed, "wallets", "attacks").where("year = 2024").count() == 0


def test_names(spark, landed):
    with pytest.raises(Exception, match="unknown source 'nobody'; known are leaks, wallets"):
        S.feed(spark, landed, "nobody", "victims").count()
    with pytest.raises(Exception, match="never landed"):
        S.feed(spark, landed, "leaks", "groups").count()
    S.register(S.Source("own", {"attacks": {"victim_name": ("who",)}}))
    try:
        os.makedirs(f"{landed}/own/attacks")
        with open(f"{landed}/own/attacks/a.json", "w") as f:
            f.write('[{"who": "z"}]')
        seen = []
        got = S.several(spark, landed, ["own", "nobody", "wallets"], "attacks", seen.append)
        assert sorted((r["source"], r["victim_name"]) for r in got.collect()) == [("own", "z"), ("wallets", "w")] and seen == ["nobody"]
    finally:
        S.SOURCES.pop("own")


def test_small_files_share_a_partition(spark, landed):
    for k in range(9):
        with open(f"{landed}/wallets/attacks/c{k}.json", "w") as f:
            json.dump([{"victim_name": f"w{k}"}] * 3, f)
    df = S.feed(spark, landed, "wallets", "attacks")
    assert df.rdd.getNumPartitions() == 1 and df.count() == 28
    assert S.feed(spark, landed, "wallets", "attacks", bytes_per_partition=100).rdd.getNumPartitions() > 4
