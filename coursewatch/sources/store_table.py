"""A store's tables as a data source: state as of a version, and what committed runs have archived.

Options: root, table, and version (the last by default). A state table has one
partition a bucket, and a predicate on course_id leaves out buckets that can't
hold the course. An archived table has one partition a committed run, with
run_id and as_of beside its columns; predicates on run_id leave runs out. Which
files there are is read from one manifest; rows are read by tasks.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ..plans.state import Store

RUN = ("run_id", "as_of")


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and the path in it, of a URI or a local path."""
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def manifest(store: fs.FileSystem, root: str, version: int | None) -> dict:
    if version is None:
        files = store.get_file_info(fs.FileSelector(f"{root}/_manifests"))
        version = max(int(posixpath.basename(f.path)[:12]) for f in files if f.path.endswith(".json") and not posixpath.basename(f.path).startswith("."))
    with store.open_input_stream(f"{root}/_manifests/{version:012d}.json") as f:
        return json.loads(f.read())


@dataclass
class Folder(InputPartition):
    path: str
    run: str | None = None
    as_of: str | None = None


_COMPARE = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


class StoreReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.options, self.names = options, [f.name for f in schema]
        self.courses: set[str] | None = None
        self.runs: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Courses and runs choose partitions; Spark still applies those on courses, as a bucket holds several."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name == "run_id" and type(f) in _COMPARE:
                self.runs.append((type(f), tuple(f.value) if isinstance(f, In) else f.value))
                continue
            if name == "course_id" and isinstance(f, (EqualTo, In)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.courses = values if self.courses is None else self.courses & values
            yield f

    def partitions(self):
        store, root = open_fs(self.options["root"])
        table, version = self.options["table"], self.options.get("version")
        now = manifest(store, root, int(version) if version else None)
        if table in now["tables"]:
            wanted = None if self.courses is None else Store.buckets_of(sorted(self.courses), now["shape"])
            return [Folder(f"{root}/{table}/{folder}/bucket={b}") for b, folder in sorted(now["tables"][table].items()) if wanted is None or int(b) in wanted]
        runs = [r for r in now["runs"] if all(_COMPARE[kind](r["run"], value) for kind, value in self.runs)]
        return [Folder(f"{root}/runs/{r['run']}/{table}", r["run"], r["as_of"]) for r in runs]

    def read(self, partition: Folder):
        store, _ = open_fs(self.options["root"])
        if store.get_file_info(partition.path).type == fs.FileType.NotFound:
            return
        data = ds.dataset(partition.path, filesystem=store, format="parquet", exclude_invalid_files=True)
        own = [n for n in self.names if n not in RUN or partition.run is None]
        for batch in data.to_batches(columns=own):
            extra = {"run_id": partition.run, "as_of": partition.as_of}
            columns = [batch.column(n) if n in own else pa.array([extra[n]] * batch.num_rows, pa.string()) for n in self.names]
            yield pa.RecordBatch.from_arrays(columns, self.names)


class StoreTable(DataSource):
    @classmethod
    def name(cls):
        return "course_store"

    def schema(self):
        store, root = open_fs(self.options["root"])
        version, table = self.options.get("version"), self.options["table"]
        now = manifest(store, root, int(version) if version else None)
        places = [f"{root}/{table}/{folder}/bucket={b}" for b, folder in now["tables"].get(table, {}).items()]
        runs = [] if places else [f"{root}/runs/{r['run']}/{table}" for r in now["runs"]]
        there = next((p for p in [*places, *runs] if store.get_file_info(p).type != fs.FileType.NotFound), None)
        if there is None:
            raise ValueError(f"the store has no table {table}")
        found = from_arrow_schema(ds.dataset(there, filesystem=store, format="parquet", exclude_invalid_files=True).schema)
        return found if places else StructType([*found.fields, *(StructField(n, StringType()) for n in RUN)])

    def reader(self, schema):
        return StoreReader(self.options, schema)


def load(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    spark.dataSource.register(StoreTable)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    read = spark.read.format("course_store").option("root", root).option("table", table)
    return (read if version is None else read.option("version", str(version))).load()


VIEWS = {"belief": "belief", "ledger": "ledger", "missing": "missing", "review": "review", "changes": "changes"}


def views(spark: SparkSession, root: str, prefix: str = "course_", version: int | None = None) -> list[str]:
    """Temporary views for SQL over the store's tables that there are, by name: course_belief, course_ledger, course_changes, ..."""
    made = []
    for name, table in VIEWS.items():
        try:
            load(spark, root, table, version).createOrReplaceTempView(prefix + name)
        except Exception as e:  # noqa: BLE001 - a store may not have a table yet
            if "has no table" not in str(e):
                raise
            continue
        made.append(prefix + name)
    return made
