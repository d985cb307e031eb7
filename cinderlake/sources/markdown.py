"""Pipe tables in Markdown. What a line means depends on those before it, so a file is read as a whole."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries of the list that are no gangs; states of an account; kinds of contact, tried in this order.
META = frozenset(("ransomchats", "ransomfeed", "ransom db", "ransomware group sites", "ransomware groups monitoring tool", "ransomnews"))
STATES = ("ONLINE", "OFFLINE", "EXPIRED", "VALID", "SUSPENDED")
CONTACTS = (
    ("telegram", r"(?i)https?://t\.me/\S+"),
    ("twitter", r"(?i)https?://(?:twitter\.com|x\.com)/\S+"),
    ("email", r"[\w.+-]+@[\w.-]+\.\w+"),
    ("tox", r"[0-9A-Fa-f]{64,}"),
    ("session", r"(?i)^05[0-9a-f]{64}$"),
    ("jabber", r"(?i)[\w.+-]+@(?:xmpp|jabber)\.\S+"),
)
#: How a cell writes a link, and what is added to a name.
_LINK = re.compile(r"\[([^\]]+)\]\(([^)]+)\)")
_QUALIFIER = re.compile(r"\s*\((?:Dark|Deep|Victims?\s*page|Clearnet|Mirror)\)", re.I)


class TableReader:
    """Data rows of pipe tables, line by line. A rule that follows a row makes that row a header after all, so a row leaves with the next line."""

    def __init__(self, heads: tuple[str, ...]):
        self.heads, self.inside, self.held = heads, False, None

    def feed(self, line: str) -> Iterator[list[str]]:
        """Cells of the row that this line shows to be one, if any."""
        line = line.strip()
        cells = [c for c in (c.strip() for c in line.split("|")) if c] if line.startswith("|") else None
        if cells == []:
            return
        rule = bool(cells) and all(set(c) <= set("-:") for c in cells)
        if self.held is not None and not rule:
            yield self.held
        self.held = None
        if cells is None:
            self.inside = False
        elif rule or cells[0].strip("*").lower() in self.heads:
            self.inside = True
        elif self.inside:
            self.held = cells

    def close(self) -> Iterator[list[str]]:
        """The last row, if no line came after it."""
        if self.held is not None:
            yield self.held


def table_rows(text: str, heads: tuple[str, ...]) -> Iterator[list[str]]:
    """Cells of data rows."""
    reader = TableReader(heads)
    for line in text.splitlines():
        yield from reader.feed(line)
    yield from reader.close()


def _linked(cell: str) -> tuple[str, str]:
    found = _LINK.search(cell)
    return (found[1], found[2]) if found else (cell, cell if cell.startswith("http") else "")


def _at(cells: list[str], k: int) -> str:
    return cells[k] if k < len(cells) else ""


def gangs(text: str) -> list[dict]:
    """Name, url, status, credentials, contacts, rss."""
    out = []
    for cells in table_rows(text, ("name",)):
        name, url = _linked(cells[0])
        name = _QUALIFIER.sub("", name).strip()
        if name.lower() not in META:
            out.append({"name": name, "url": url if _LINK.search(cells[0]) else "", "status": _at(cells, 1).upper(), "credentials": _at(cells, 2), "comms_raw": _at(cells, 3), "rss": _at(cells, 4)})
    return out


def telegram(text: str) -> list[dict]:
    """Name, url, status and kind of attack; rows without name or url go."""
    rows = [{"name": _at(c, 2), "url": _linked(c[0])[1], "status": _at(c, 1).upper(), "attack_type": _at(c, 3)} for c in table_rows(text, ("telegram", "link"))]
    return [r for r in rows if r["name"] and r["url"]]


def twitter(text: str) -> list[dict]:
    """Name, url and the first known state; rows without name or url go."""
    rows = [{"name": _at(c, 1), "url": _linked(c[0])[1], "status": next((x.upper() for x in c[2:] if x.upper() in STATES), "")} for c in table_rows(text, ("link", "twitter"))]
    return [r for r in rows if r["name"] and r["url"]]


def parsed(spark: SparkSession, path: str, parser: Callable[[str], list[dict]], fields: str) -> DataFrame:
    """``file, pos`` and ``fields`` (comma-separated strings) of all Markdown files of a path."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(parser)

    kind = "array<struct<" + ",".join(f"{f}:string" for f in fields.split(",")) + ">>"
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.select("file", F.posexplode(F.pandas_udf(run, kind)("value")).alias("pos", "r")).select("file", "pos", "r.*")


def contacts(raw: Column) -> Column:
    """``array<struct<kind, value>>`` of a contact cell: parts between dashes, commas and bars, first kind that fits."""
    parts = F.filter(F.transform(F.split(raw, r"\s*[-–—]\s*|\s*,\s*|\s*\|\s*"), lambda p: F.trim(p)), lambda p: p != "")

    def one(p: Column) -> Column:
        kind, value = F.lit(None).cast("string"), F.lit(None).cast("string")
        for name, pattern in (("website", "^http.*$"), *reversed(CONTACTS)):
            hit = F.regexp_extract(p, pattern, 0)
            kind, value = F.when(hit != "", name).otherwise(kind), F.when(hit != "", hit).otherwise(value)
        return F.struct(kind.alias("kind"), value.alias("value"))

    return F.filter(F.transform(parts, one), lambda c: c["kind"].isNotNull())
