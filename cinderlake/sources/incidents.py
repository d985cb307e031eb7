"""Landed feeds as a Spark data source: ``spark.read.format("incidents")``.

A source has up to four feeds: ``victims``, ``groups`` and ``attacks`` are what it shows at present, ``victims_history`` and
``attacks_history`` all that it ever had, by year and month. Sources are known by name (:data:`SOURCES`); each says which
keys of its JSON make which column. They are landed as

    <path>/<source>/<feed>/year=2024/month=3/<any>        (history)
    <path>/<source>/<feed>/<any>                          (present)

where a file is a JSON array, or an object that holds one; names that begin with ``_`` or ``.`` are passed over. The options ``years`` and ``months`` (``2022-2024,2019``) choose folders: others
are not listed, and their files not opened. Every file is a partition of its own, or several small ones together
up to ``bytes_per_partition``.

With the option ``pushdown`` filters on ``year`` and ``month`` choose folders, too. Spark 4.1 keeps what was pushed with the loaded table and not with the
scan, so a table that one plan scans with different filters gives wrong rows then: the option is for a table that is loaded for one scan.
Without it filters are applied by Spark after reading, which is always right.

Defined results: of a source that has no history, the history of victims is empty and that of attacks is what it shows at present. A feed that never
landed is an error, as is an unknown name; a folder without files is an empty feed. A file that can't be read as JSON fails the query,
or with the option ``mode`` = ``PERMISSIVE`` gives one row with its name in ``_corrupt``. Entries that aren't objects are left out; a value that is
neither text nor number becomes its JSON. A folder ``year=`` without a whole number is left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)

#: Rows of a batch.
ROWS_AT_ONCE = 10_000
PRESENT, HISTORY = ("victims", "groups", "attacks"), ("victims_history", "attacks_history")
COLUMNS = {
    "victims": "victim_name string, group_name string, attackdate string, discovered string, domain string, country string, description string, activity string, url string",
    "groups": "name string, altname string, description string, type string, locations string",
    "attacks": "victim_name string, attack_date string, country string, title string, url string, summary string, domain string",
}


@dataclass(frozen=True)
class Source:
    """A source by name. ``keys``: per feed and column the keys to try in turn, where they aren't the column's name."""

    name: str
    keys: dict[str, dict[str, tuple[str, ...]]] = field(default_factory=dict)
    below: tuple[str, ...] = ()
    history: bool = False

    def rows(self, feed: str, data) -> Iterator[tuple]:
        """Values of the columns of a feed for each entry of a file."""
        for key in self.below:
            data = data.get(key, []) if isinstance(data, dict) else data
        of = self.keys.get(feed, {})
        names = [(n, of.get(n, (n,))) for n in column_names(feed)]
        for entry in data if isinstance(data, list) else [data]:
            if isinstance(entry, dict):
                yield tuple(_text(next((entry[k] for k in keys if entry.get(k) not in (None, "")), None)) for _, keys in names)


SOURCES: dict[str, Source] = {}


def register(source: Source) -> Source:
    """Make a source known by its name; a later one of that name takes its place."""
    SOURCES[source.name] = source
    return source


#: Names of fields in the feeds.
LEAKS = register(Source("leaks", {"victims": {"victim_name": ("victim", "post_title")}, "attacks": {"victim_name": ("victim",), "attack_date": ("date", "attack_date")}}, history=True))
WALLETS = register(Source("wallets", {"groups": {"name": ("family",)}}, below=("result",)))


def column_names(feed: str) -> list[str]:
    return [c.split()[0] for c in COLUMNS[feed].split(", ")]


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return str(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else json.dumps(value, ensure_ascii=False)


@dataclass
class Files(InputPartition):
    """Files of one year and month, None for a present feed."""

    year: int | None
    month: int | None
    paths: tuple[str, ...]


def _holds(f: Filter, value: int | None) -> bool:
    """Whether a filter on year or month can hold for a folder with that value."""
    if isinstance(f, IsNotNull):
        return value is not None
    if value is None:
        return False
    if isinstance(f, In):
        return value in f.value
    compare = {EqualTo: value.__eq__, EqualNullSafe: value.__eq__, GreaterThan: value.__gt__, GreaterThanOrEqual: value.__ge__, LessThan: value.__lt__, LessThanOrEqual: value.__le__}
    return bool(compare[type(f)](f.value))


def numbers(text: str | None) -> list[tuple[int, int]] | None:
    """Ranges from ``2022-2024,2019``; None without any."""
    if not text:
        return None
    ends = [part.strip().split("-") for part in text.split(",")]
    return [(int(e[0]), int(e[-1])) for e in ends]


PUSHED = (EqualTo, EqualNullSafe, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In, IsNotNull)


class Reader(DataSourceReader):
    """Plans folders by the options and pushed filters, then files by size."""

    def __init__(self, source: Source, feed: str, options: dict):
        self.source, self.feed, self.options = source, feed, dict(options)
        self.wanted: dict[str, list[Filter]] = {"year": [], "month": []}
        self.chosen = {"year": numbers(self.options.get("years")), "month": numbers(self.options.get("months"))}

    def _folder(self) -> tuple[object, str, bool]:
        """File system, folder and whether it has years."""
        from pyarrow import fs

        kind, history = self.feed.removesuffix("_history"), self.feed in HISTORY
        system, root = fs.FileSystem.from_uri(self.options["path"]) if "://" in self.options["path"] or self.options["path"].startswith("file:") else (fs.LocalFileSystem(), self.options["path"])
        return system, f"{root.rstrip('/')}/{self.source.name}/{self.feed if history and self.source.history else kind}", history and self.source.history

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        if self.feed == "victims_history" and not self.source.history:
            return []
        fits = lambda name, v: (self.chosen[name] is None or v is not None and any(a <= v <= b for a, b in self.chosen[name])) and all(_holds(f, v) for f in self.wanted[name])
        system, folder, dated = self._folder()
        if system.get_file_info(folder).type != fs.FileType.Directory:
            raise FileNotFoundError(f"feed {self.feed} of {self.source.name} never landed: {folder}")
        listed = lambda path: sorted(system.get_file_info(fs.FileSelector(path)), key=lambda i: i.path)
        below = lambda path, name: [(int(m[1]), i.path) for i in listed(path) if (m := re.fullmatch(rf"{name}=(\d+)", i.base_name)) and fits(name, int(m[1]))]
        if dated:
            places = [(y, m, path) for y, above in below(folder, "year") for m, path in below(above, "month")]
        else:
            places = [(None, None, folder)] if all(fits(name, None) for name in self.wanted) else []
        most, out = int(self.options.get("bytes_per_partition", 64_000_000)), []
        for year, month, path in places:
            held, size = [], 0
            for i in listed(path):
                if i.type != fs.FileType.File or i.base_name.startswith(("_", ".")):
                    continue
                if held and size + i.size > most:
                    out.append(Files(year, month, tuple(held)))
                    held, size = [], 0
                held.append(i.path)
                size += i.size
            if held:
                out.append(Files(year, month, tuple(held)))
        return out

    def read(self, partition: Files) -> Iterator:
        """Arrow batches of up to ``ROWS_AT_ONCE`` rows."""
        import pyarrow as pa

        system, _, _ = self._folder()
        kind = self.feed.removesuffix("_history")
        names = column_names(kind)

        def batch(rows: list[tuple], corrupt: str | None = None):
            columns = [pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))]
            dated = [pa.array([v] * len(rows), pa.int32()) for v in (partition.year, partition.month)]
            return pa.RecordBatch.from_arrays([*columns, *dated, pa.array([corrupt] * len(rows), pa.string())], [*names, "year", "month", "_corrupt"])

        for path in partition.paths if partition else ():  # without partitions Spark reads once, with none
            with system.open_input_stream(path) as stream:
                body = stream.read()
            try:
                data = json.loads(body)
            except ValueError:
                if self.options.get("mode", "FAILFAST").upper() != "PERMISSIVE":
                    raise ValueError(f"not JSON: {path}") from None
                yield batch([(None,) * len(names)], path)
                continue
            entries = self.source.rows(kind, data)
            while rows := list(islice(entries, ROWS_AT_ONCE)):
                yield batch(rows)


class PushedReader(Reader):
    """Takes filters, too."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if isinstance(f, PUSHED) and len(f.attribute) == 1 else None
            if name in self.wanted:
                self.wanted[name].append(f)
            else:
                yield f


class Incidents(DataSource):
    """Options: ``path``, ``source``, ``feed``; ``years``, ``months``, ``mode``, ``bytes_per_partition``, ``pushdown``."""

    @classmethod
    def name(cls) -> str:
        return "incidents"

    def _named(self) -> tuple[Source, str]:
        name, feed = self.options.get("source", ""), self.options.get("feed", "victims")
        known = {s.name: s for s in self.sources()}
        if name not in known:
            raise ValueError(f"unknown source {name!r}; known are {', '.join(sorted(known))}")
        if feed not in PRESENT + HISTORY:
            raise ValueError(f"unknown feed {feed!r}")
        return known[name], feed

    @classmethod
    def sources(cls) -> list[Source]:
        return list(SOURCES.values())

    def schema(self) -> str:
        _, feed = self._named()
        return COLUMNS[feed.removesuffix("_history")] + ", year int, month int, _corrupt string"

    def reader(self, schema) -> Reader:
        source, feed = self._named()
        pushed = str(self.options.get("pushdown", "")).lower() == "true"
        return (PushedReader if pushed else Reader)(source, feed, self.options)


def use(spark: SparkSession) -> None:
    """Register the format for a session, with the sources known by now."""
    known = list(SOURCES.values())

    class Known(Incidents):
        @classmethod
        def sources(cls) -> list[Source]:
            return known

    spark.dataSource.register(Known)


def feed(spark: SparkSession, path: str, source: str, name: str, **options) -> DataFrame:
    """A feed of a source. Options are those of :class:`Incidents`."""
    use(spark)
    if options.get("pushdown"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("incidents").options(source=source, feed=name, **options).load(path)


def several(spark: SparkSession, path: str, names: list[str], name: str, log: Callable[[str], None] = lambda _: None) -> DataFrame | None:
    """One feed of several sources with their names in ``source``; unknown names are logged and left out."""
    from pyspark.sql import functions as F

    out = None
    for n in names:
        if n not in SOURCES:
            log(n)
            continue
        one = feed(spark, path, n, name).withColumn("source", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out
