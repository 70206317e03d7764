"""Growing logs as a paged source, and exports that appear whole or not at all: Python data sources.

Both work on folders that driver and executors share under the same path.
"""

from __future__ import annotations

import csv
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a log that one task reads.
PAGE = 8 << 20


def local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


@dataclass
class Page(InputPartition):
    """The lines that begin in a range of bytes."""

    lo: int
    hi: int


class _Log:
    def __init__(self, options: dict):
        self.path, self.page = local(options["path"]), int(options.get("page", PAGE))

    def whole(self) -> int:
        """Bytes up to the end of the last complete line; what is still being written comes later."""
        if not os.path.exists(self.path):
            return 0
        end = os.path.getsize(self.path)
        with open(self.path, "rb") as f:
            while end:
                lo = max(0, end - (1 << 16))
                f.seek(lo)
                at = f.read(end - lo).rfind(b"\n")
                if at >= 0:
                    return lo + at + 1
                end = lo
        return 0

    def pages(self, lo: int, hi: int) -> list[Page]:
        return [Page(a, min(a + self.page, hi)) for a in range(lo, hi, self.page)] or [Page(lo, lo)]

    def lines(self, p: Page) -> Iterator[tuple[int, str]]:
        if p.lo >= p.hi:
            return
        with open(self.path, "rb") as f:
            at = p.lo
            if at:  # a line that began before belongs to the page before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < p.hi:
                line = f.readline()
                if not line:
                    return
                yield at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)


class LogReader(_Log, DataSourceReader):
    def partitions(self) -> list[Page]:
        return self.pages(0, self.whole())

    def read(self, partition: Page) -> Iterator[tuple[int, str]]:
        return self.lines(partition)


class LogStream(_Log, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"bytes": 0}

    def latestOffset(self) -> dict:
        return {"bytes": self.whole()}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return self.pages(start["bytes"], end["bytes"])

    def read(self, partition: Page) -> Iterator[tuple[int, str]]:
        return self.lines(partition)


class Log(DataSource):
    """(offset, line) of a text file that lines are appended to, in pages of bytes; options path and page. As a stream it goes on where it was."""

    @classmethod
    def name(cls) -> str:
        return "larkspur_log"

    def schema(self) -> str:
        return "offset long, line string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return LogReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LogStream(self.options)


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class CsvExportWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = local(options["path"]).rstrip("/"), columns
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        os.makedirs(self.staging, exist_ok=True)
        # Each attempt has a file of its own, so that one that is given up, or still runs elsewhere, spoils nothing.
        name, rows = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.csv", 0
        with open(f"{self.staging}/{name}", "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator="\n")
            out.writerow(self.columns)
            for row in iterator:
                out.writerow(["" if v is None else v for v in row])
                rows += 1
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        kept = {m.file for m in messages if m}
        os.makedirs(self.staging, exist_ok=True)
        for f in os.listdir(self.staging):
            if f not in kept:
                os.remove(f"{self.staging}/{f}")
        old = f"{self.path}.old-{uuid.uuid4().hex}"
        if os.path.exists(self.path):
            os.rename(self.path, old)
        os.rename(self.staging, self.path)
        shutil.rmtree(old, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class CsvExport(DataSource):
    """A folder of CSV files with headers that takes its place, by one rename, once all of them are written; option path."""

    @classmethod
    def name(cls) -> str:
        return "larkspur_csv"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return CsvExportWriter(self.options, schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Log)
    spark.dataSource.register(CsvExport)


def read_log(spark: SparkSession, path: str, page: int = PAGE) -> DataFrame:
    register(spark)
    return spark.read.format("larkspur_log").option("path", path).option("page", page).load()


def stream_log(spark: SparkSession, path: str, page: int = PAGE) -> DataFrame:
    register(spark)
    return spark.readStream.format("larkspur_log").option("path", path).option("page", page).load()


def export_csv(df: DataFrame, path: str) -> None:
    """df as text in a folder of CSV files: nulls empty, maps as "key: value; key: value"; an export that fails leaves path as it was."""
    from larkspur.sources.payloads import csv_cells

    register(df.sparkSession)
    csv_cells(df, df.columns).write.format("larkspur_csv").option("path", path).mode("append").save()
