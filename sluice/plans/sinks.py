"""Loaders as registered sinks (X4): a run's rows go to any target through a two-phase commit.

A loader is a class that the workers can import. Every task calls ``load``
with its rows and returns a receipt; nothing may be visible then. The driver's
``commit`` gets the receipts of all tasks and makes their rows visible at once;
if a task or the job fails, ``abort`` gets the receipts there are and removes
what was left. Spark may run a task twice, of which one receipt counts.
"""

from __future__ import annotations

import importlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from sluice.plans.config import PipelineConfig

FORMAT = "sluice_sink"


class Loader:
    """Base of a sink's loader; ``options`` are those of its registration and the run's ``execution_id``."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def load(self, rows: Iterator[Row]) -> Any:
        """Take a task's rows, on an executor; the receipt must be picklable."""
        raise NotImplementedError

    def commit(self, receipts: list[Any]) -> None:
        """Make the rows of all receipts visible, on the driver."""
        raise NotImplementedError

    def abort(self, receipts: list[Any]) -> None:
        """Remove what the tasks of a failed job left, on the driver; tasks without a receipt included."""
        raise NotImplementedError


class JsonLinesLoader(Loader):
    """Rows as JSON lines in ``<root>/<execution id>``: a file per task, moved in from a pending folder by the commit.

    ``root`` is a path or URI that driver and executors share.
    """

    def _places(self):
        from pyarrow import fs

        root = self.options["root"]
        found, path = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        run = self.options["execution_id"]
        return found, f"{path}/_pending/{run}", f"{path}/{run}"

    def load(self, rows: Iterator[Row]) -> Any:
        store, pending, _ = self._places()
        name, n = f"{uuid.uuid4().hex}.jsonl", 0
        store.create_dir(pending, recursive=True)
        with store.open_output_stream(f"{pending}/{name}") as out:
            for row in rows:
                out.write((json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False) + "\n").encode())
                n += 1
        return name, n

    def commit(self, receipts: list[Any]) -> None:
        store, pending, final = self._places()
        store.create_dir(final, recursive=True)
        for name, n in receipts:
            if n:
                store.move(f"{pending}/{name}", f"{final}/{name}")
        # files of tasks that ran twice have no receipt
        store.delete_dir(pending)

    def abort(self, receipts: list[Any]) -> None:
        from pyarrow import fs

        store, pending, _ = self._places()
        if store.get_file_info(pending).type != fs.FileType.NotFound:
            store.delete_dir(pending)


@dataclass(frozen=True)
class Sink:
    loader: str
    options: dict[str, str] = field(default_factory=dict)


SINKS: dict[str, Sink] = {}


def register_sink(name: str, loader: type[Loader], **options: str) -> None:
    """Extension hook: a loader class (of a module that the workers can import) under a name, with its options."""
    SINKS[name.upper()] = Sink(f"{loader.__module__}:{loader.__qualname__}", {k: str(v) for k, v in options.items()})


@dataclass
class Receipt(WriterCommitMessage):
    value: Any


class SinkWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def _loader(self) -> Loader:
        module, _, name = self.options["loader"].partition(":")
        given = json.loads(self.options["options"])
        return getattr(importlib.import_module(module), name)({**given, "execution_id": self.options["execution"]})

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        return Receipt(self._loader().load(iterator))

    def commit(self, messages) -> None:
        self._loader().commit([m.value for m in messages if m is not None])

    def abort(self, messages) -> None:
        self._loader().abort([m.value for m in messages if m is not None])


class SinkSource(DataSource):
    """The format by which Spark writes to a registered sink."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return SinkWriter(self.options)


def deliver(rows: DataFrame, sink: str, execution_id: str, cfg: PipelineConfig) -> int:
    """Write a run's rows to a registered sink; returns their number, counted by the write."""
    found = SINKS.get(sink.upper())
    if found is None:
        raise ValueError(f"No loader is registered as {sink}")
    rows.sparkSession.dataSource.register(SinkSource)
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.format(FORMAT).mode("append").options(
        loader=found.loader, options=json.dumps({"pipeline_id": cfg.id, **found.options}), execution=execution_id).save()
    return seen.get["rows"]
