"""Table functions for SQL: rows leave as they are found, so that no text's rows are ever held as one array.

    register(spark)
    SELECT d.doc_id, i.* FROM documents d, LATERAL indicators(d.text) i

and for lines of files, each file in order in one instance, of which one row is held:

    SELECT * FROM markdown_lines(TABLE(lines) PARTITION BY (file) ORDER BY (pos))
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="kind string, value string, start int, end int, defanged boolean", useArrow=True)
class Indicators:
    """Indicators of a text, each (kind, value) at its first place; a null text has none."""

    def eval(self, text: str) -> Iterator[tuple]:
        from cinderlake.functions.indicators import found

        for kind, value, start, end, defanged in found(text):
            yield kind, value, start, end, defanged


@udtf(returnType="rule string, text string, start int, end int, note string", useArrow=True)
class Breaches:
    """Breaches of the house style in a text, by place; a null text has none. ``advice_allowed`` is false for assessments."""

    def eval(self, text: str, advice_allowed: bool) -> Iterator[tuple]:
        from cinderlake.operators.style import breaches

        yield from breaches(text or "", True if advice_allowed is None else advice_allowed)


@udtf(returnType="file string, pos bigint, cells array<string>", useArrow=True)
class MarkdownLines:
    """Cells of the data rows of pipe tables in files whose lines (file, pos, line) come in order; ``pos`` counts a file's rows from 0.

    A table's first header cell is one of ``heads`` (comma-separated). A file is a partition; a null line is empty.
    """

    def __init__(self):
        self._reader, self._file, self._pos = None, None, 0

    def _numbered(self, rows) -> Iterator[tuple]:
        for cells in rows:
            yield self._file, self._pos, cells
            self._pos += 1

    def eval(self, row: Row, heads: str) -> Iterator[tuple]:
        from cinderlake.sources.markdown import TableReader

        if self._reader is None:
            self._reader, self._file = TableReader(tuple(heads.split(","))), row["file"]
        yield from self._numbered(self._reader.feed(row["line"] or ""))

    def terminate(self) -> Iterator[tuple]:
        if self._reader is not None:
            yield from self._numbered(self._reader.close())


#: Names under which ``register`` makes them known to SQL.
FUNCTIONS = {"indicators": Indicators, "breaches": Breaches, "markdown_lines": MarkdownLines}


def register(spark: SparkSession) -> None:
    """Make the table functions known to a session's SQL."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
