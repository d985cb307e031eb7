"""An outbox of notification batches as a streaming sink: ``df.writeStream.format("outbox")``.

Every task writes its events to a file of its own, a line per batch ``{"events": [...]}`` of at most ``size`` events, and hands its name to the driver. Only
the commit of a micro-batch makes files count: it lists them in a manifest that has the number of the micro-batch, and is moved into place as a whole. A task that is
repeated, or a micro-batch that dies, leaves files that no manifest names; a micro-batch that is committed again finds its manifest and clears what it
wrote. So whoever reads by the manifests sees each event once.

Times are ISO 8601 in UTC; nulls are left out. A micro-batch without events has an empty manifest.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    """The file of a task, None if it had no events."""

    name: str | None


def _system(path: str) -> tuple:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _value(v):
    if isinstance(v, dt.datetime):
        return (v if v.tzinfo else v.astimezone(dt.UTC)).astimezone(dt.UTC).isoformat().replace("+00:00", "Z")
    if isinstance(v, dt.date):
        return v.isoformat()
    return v if isinstance(v, (str, int, float, bool, list, dict)) else str(v)


class Writer(DataSourceStreamWriter):
    """Files by tasks, manifests by the driver."""

    def __init__(self, options: dict, columns: list[str]):
        self.path, self.size, self.columns = options["path"].rstrip("/"), int(options.get("size", 100)), columns

    def write(self, iterator: Iterator) -> Written:
        system, root = _system(self.path)
        held, name, out = [], f"{uuid.uuid4().hex}.json", None

        def line() -> bytes:
            body = json.dumps({"events": held}, ensure_ascii=False).encode() + b"\n"
            held.clear()
            return body

        for row in iterator:
            if out is None:
                system.create_dir(f"{root}/data", recursive=True)
                out = system.open_output_stream(f"{root}/data/{name}")
            held.append({c: _value(row[c]) for c in self.columns if row[c] is not None})
            if len(held) == self.size:
                out.write(line())
        if out is None:
            return Written(None)
        if held:
            out.write(line())
        out.close()
        return Written(name)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        from pyarrow import fs

        system, root = _system(self.path)
        system.create_dir(f"{root}/commits", recursive=True)
        target = f"{root}/commits/{batchId}.json"
        if system.get_file_info(target).type != fs.FileType.NotFound:
            return self.abort(messages, batchId)
        passing = f"{target}.{uuid.uuid4().hex}"
        with system.open_output_stream(passing) as out:
            out.write(json.dumps([m.name for m in messages if m is not None and m.name]).encode())
        system.move(passing, target)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        system, root = _system(self.path)
        for m in messages:
            if m is not None and m.name:
                system.delete_file(f"{root}/data/{m.name}")


class Outbox(DataSource):
    """Options: ``path``, ``size``."""

    @classmethod
    def name(cls) -> str:
        return "outbox"

    def streamWriter(self, schema, overwrite: bool) -> Writer:  # noqa: N802
        return Writer(dict(self.options), schema.fieldNames())


def send(events: DataFrame, path: str, checkpoint: str, size: int = 100):
    """Start a query that puts what has arrived of a stream into the outbox, and ends."""
    events.sparkSession.dataSource.register(Outbox)
    return events.writeStream.format("outbox").option("path", path).option("size", size).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def manifests(path: str) -> list[list[str]]:
    """Names of the files of each committed micro-batch, in order."""
    from pyarrow import fs

    system, root = _system(path)
    if system.get_file_info(f"{root}/commits").type != fs.FileType.Directory:
        return []
    names = [i.path for i in system.get_file_info(fs.FileSelector(f"{root}/commits")) if i.path.endswith(".json")]
    return [json.loads(system.open_input_stream(p).read()) for p in sorted(names, key=lambda p: int(p.rsplit("/", 1)[1].split(".")[0]))]


def batches(spark: SparkSession, path: str) -> DataFrame:
    """``payload, n``: the batches of all committed files."""
    files = [f"{path.rstrip('/')}/data/{name}" for names in manifests(path) for name in names]
    lines = spark.read.text(files) if files else spark.createDataFrame([], "value string")
    return lines.select(F.col("value").alias("payload"), F.json_array_length(F.get_json_object("value", "$.events")).alias("n"))


def events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The events of all committed files."""
    kind = ",".join(f"{c.strip().split()[0]}:{c.strip().split()[1]}" for c in schema.split(","))
    return batches(spark, path).select(F.explode(F.from_json("payload", f"struct<events:array<struct<{kind}>>>")["events"]).alias("e")).select("e.*")
