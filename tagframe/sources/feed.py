"""A store's change log as a streaming source: ``spark.readStream.format("tagframe_changes").option("path", store)``.

The offset is a version. Every micro-batch takes the changes after the last one up to the newest commit, a task per part of the
log; a query's checkpoint keeps the version, so that a restart neither loses nor repeats changes, whatever was written
meanwhile. ``startingVersion`` sets where a new query begins (default 0: all changes that are kept). ``commitsPerTrigger`` bounds a batch
to the changes of so many commits. A reader that has fallen behind the log's floor gets an error, never a silent skip.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tagframe.operators.changes import ChangelogGap
from tagframe.operators.store import LOG

from .lines import open_path

NAME = "tagframe_changes"


@dataclass
class Part(InputPartition):
    path: str
    after: int
    upto: int


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.start, self.commits = options["path"].rstrip("/"), int(options.get("startingversion", "0")), int(options.get("commitspertrigger", "0"))
        self.seen = self.start

    def _commits(self) -> list[str]:
        fs, at = open_path(f"{self.path}/commits")
        files = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
        return sorted(f.path for f in files if f.base_name.endswith(".json") and not f.base_name.startswith("."))

    def _head(self) -> dict:
        names = self._commits()
        if not names:
            return {"version": 0, "floor": 0, "log": []}
        fs, _ = open_path(f"{self.path}/commits")
        with fs.open_input_stream(names[-1]) as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"version": self.start}

    def latestOffset(self, start: dict | None = None, limit=None) -> dict:
        head = self._head()
        if self.commits:
            ends = sorted(p["last"] for p in head["log"] if p["last"] > self.seen)
            return {"version": ends[min(self.commits, len(ends)) - 1] if ends else max(self.seen, head["version"])}
        return {"version": max(head["version"], self.start)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        after, upto = start["version"], end["version"]
        self.seen = max(self.seen, upto)
        if upto <= after:
            return []
        head = self._head()
        if head["floor"] > 0 and after < head["floor"]:
            raise ChangelogGap(f"changes after {after} are gone, the log starts after {head['floor']}")
        return [Part(f"{self.path}/{p['path']}", after, upto) for p in head["log"] if p["last"] > after and p["first"] <= upto]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fs, at = open_path(partition.path)
        form = ds.ParquetFileFormat(coerce_int96_timestamp_unit="us")
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.base_name.endswith(".parquet")]
        if not files:
            return
        rows = ds.dataset(files, filesystem=fs, format=form)
        wanted = to_arrow_schema(LOG)
        inside = (ds.field("version") > partition.after) & (ds.field("version") <= partition.upto)
        for batch in rows.to_batches(columns=LOG.names, filter=inside, batch_size=4096):
            if batch.num_rows:
                yield from pa.Table.from_batches([batch]).cast(wanted).to_batches()


class ChangeFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        return LOG

    def streamReader(self, schema: StructType) -> ChangeReader:
        return ChangeReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChangeFeed)
