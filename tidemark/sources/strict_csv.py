"""A CSV source that rejects what lenient readers repair: `spark.read.format("strict_csv")`.

Every column is text. A byte-order mark and blank lines are skipped. Empty or repeated header names, rows of another
length than the header and unclosed quotes are errors. `row_no` counts data rows from 1. A quoted field may hold line
ends, so one file is one task; give many files for parallel reads.
"""

from __future__ import annotations

import csv
import glob
import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType


class CsvFormatError(ValueError):
    pass


def header(path: str, required: tuple[str, ...] = ()) -> list[str]:
    with open(path, encoding="utf-8-sig", newline="") as f:
        names = next(csv.reader(f, strict=True), None)
    if not names or any(not n.strip() for n in names):
        raise CsvFormatError("CSV needs a header without blank names")
    if len(set(names)) != len(names):
        raise CsvFormatError("CSV header names must be unique")
    if missing := sorted(set(required) - set(names)):
        raise CsvFormatError("missing CSV columns: " + ", ".join(missing))
    return names


def files(path: str) -> list[str]:
    found = sorted(glob.glob(os.path.join(path, "*.csv"))) if os.path.isdir(path) else [path]
    if not found:
        raise CsvFormatError(f"no CSV file in {path}")
    return found


class Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, required: tuple[str, ...]):
        self.names, self.path, self.required = schema.names[:-1], path, required

    def partitions(self):
        return [Part(p) for p in files(self.path)]

    def read(self, partition):
        if header(partition.path, self.required) != self.names:
            raise CsvFormatError("files of one source need one header")
        with open(partition.path, encoding="utf-8-sig", newline="") as f:
            number = 0
            rows = csv.reader(f, strict=True)
            next(rows)
            for row in rows:
                if not row:
                    continue
                number += 1
                if len(row) != len(self.names):
                    raise CsvFormatError(f"data row {number}: field count differs from header")
                yield (*row, number)


class StrictCsv(DataSource):
    @classmethod
    def name(cls):
        return "strict_csv"

    def _required(self) -> tuple[str, ...]:
        return tuple(x for x in self.options.get("required", "").split(",") if x)

    def schema(self):
        names = header(files(self.options["path"])[0], self._required())
        return StructType([*(StructField(n, StringType()) for n in names), StructField("row_no", LongType())])

    def reader(self, schema):
        return Reader(schema, self.options["path"], self._required())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StrictCsv)
