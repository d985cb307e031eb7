"""Table functions against the functions that give arrays."""

import resource

from cinderlake.functions import tables
from cinderlake.functions.indicators import found, scan
from cinderlake.operators.style import breaches
from cinderlake.sources.markdown import table_rows

TEXT = "See 1.2.3[.]4 and hxxp://a[.]org/x, mail x@y.org, " + "0" * 32


def test_lateral_rows_are_those_of_the_arrays(spark):
    tables.register(spark)
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "plain")], "id int, text string")
    got = spark.sql("SELECT id, i.* FROM {df} d, LATERAL indicators(d.text) i", df=df).collect()
    assert [tuple(r)[1:] for r in got] == [tuple(x.values()) for x in scan(TEXT)] and {r["id"] for r in got} == {1}
    prose = "This is basically crucial. It could, potentially, matter."
    got = spark.sql("SELECT b.* FROM VALUES (?), (NULL) AS t(p), LATERAL breaches(t.p, false) b", args=[prose]).collect()
    assert [tuple(r) for r in got] == breaches(prose, False)


def test_lines_are_parsed_in_order_within_files(spark):
    tables.register(spark)
    files = {"a": "| Name | X |\n|--|--|\n| 1 | 2 |\n| 3 | 4 |\n|-|-|\n| 5 | 6 |", "b": "| no | table |\n", "c": "text\n\n|name|\n|q|\n||\n|r|\nend\n|s|"}
    lines = [(f, k, line) for f, text in files.items() for k, line in enumerate(text.splitlines())] + [("d", 0, None)]
    df = spark.createDataFrame(lines[::-1], "file string, pos bigint, line string")
    got = spark.sql("SELECT * FROM markdown_lines(TABLE({df}) PARTITION BY (file) ORDER BY (pos), 'name')", df=df).orderBy("file", "pos").collect()
    assert [tuple(r) for r in got] == [(f, k, c) for f, text in files.items() for k, c in enumerate(table_rows(text, ("name",)))]


def test_rows_leave_as_they_are_found():
    """A text of 200,000 addresses gives its first row at once, and no list of rows is held."""
    text = " ".join(f"10.{k >> 16}.{k >> 8 & 255}.{k & 255}" for k in range(200_000))
    rows = found(text)
    assert next(rows)[1] == "10.0.0.0"
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert sum(1 for _ in rows) == 199_999
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000
