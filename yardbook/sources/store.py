"""Tables of a folder under one manifest: a version names the files of every table.

A change writes its files aside, in folders that no reader knows, and ends by putting one small manifest
in place; that rename is the only step readers can see. A change that stops before it leaves the old
version as it was, whatever it had written; two changes that start from the same version cannot both end.
Files are never written again, so a reader keeps the version it opened until ``vacuum`` is called.

Layout below the folder: ``data/<table>/write_id=<id>/[month_key=<month>/]*.parquet`` and
``manifests/<number>.json``. Only months are listed in a manifest, no files, so its size does not grow with
the rows.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yardbook.functions.periods import MONTH_KEY, by_month, month_start, period_bounds
from yardbook.sources.catalog import Catalog

WRITE_ID = "write_id"
# Codec of the files, and the months that a writer keeps open before it sorts the rest.
CODEC, OPEN_MONTHS = "zstd", 16
_NUMBER = re.compile(r"^(\d{12})\.json$")


class VersionConflict(RuntimeError):
    """Another change became the next version first."""


@contextmanager
def _months_at_once(spark: SparkSession) -> Iterator[None]:
    """Within it a writer keeps files of several months open, so it need not sort its rows by month (and spill them)."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(OPEN_MONTHS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class TableStore:
    """The versions of the tables in one folder, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # --- reading -----------------------------------------------------------------------------------

    def version(self) -> int:
        """Number of the current version; 0 before the first change."""
        return max(self._numbers(), default=0)

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self._manifest(version))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as it is in a version, by default the current one."""
        return self._frame(name, self._manifest(version)[name])

    def catalog(self, version: int | None = None) -> Catalog:
        """All tables of one version; a later change does not alter what it reads."""
        entries = self._manifest(version)
        return Catalog(self.spark, {name: self._frame(name, entry) for name, entry in entries.items()})

    def folders(self, name: str, version: int | None = None) -> dict[str, str]:
        """Month (empty for a table without months) and the folder that holds it."""
        return dict(self._manifest(version)[name]["folders"])

    # --- changing ----------------------------------------------------------------------------------

    def change(self) -> "Change":
        """Start a change of one or more tables; use it in a ``with`` block."""
        return Change(self)

    def vacuum(self, keep: int = 1, hours: float = 24) -> int:
        """Delete all versions but the last ``keep`` and the files that none of these name.

        Files younger than ``hours`` stay, as a change that is still running may have written them.
        Manifests go first, so a stop in between leaves files without readers and never the reverse.
        Returns the number of deleted folders.
        """
        if keep < 1:
            raise ValueError("at least one version stays")
        numbers = sorted(self._numbers())
        for number in numbers[:-keep]:
            self._delete(self._manifest_path(number))
        named = {folder for n in numbers[-keep:] for e in self._manifest(n).values() for folder in e["folders"].values()}
        writes = {folder.split(f"/{MONTH_KEY}=")[0] for folder in named}
        oldest, gone = time.time() - hours * 3600, 0
        for table in self._list(f"{self.folder}/data"):
            for write in self._list(table):
                own = write.removeprefix(f"{self.folder}/")
                inside = [write] if own not in writes else [m for m in self._list(write) if f"/{MONTH_KEY}=" in m]
                for path in inside:
                    if path.removeprefix(f"{self.folder}/") not in named and self._modified(path) <= oldest:
                        self._delete(path)
                        gone += 1
        return gone

    # --- files -------------------------------------------------------------------------------------

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, path: str) -> list[str]:
        if not self._files().exists(self._path(path)):
            return []
        return [f"{path}/{status.getPath().getName()}" for status in self._files().listStatus(self._path(path))]

    def _modified(self, path: str) -> float:
        return self._files().getFileStatus(self._path(path)).getModificationTime() / 1000

    def _delete(self, path: str) -> None:
        self._files().delete(self._path(path), True)

    def _manifest_path(self, number: int) -> str:
        return f"{self.folder}/manifests/{number:012d}.json"

    def _numbers(self) -> list[int]:
        names = (_NUMBER.match(path.rsplit("/", 1)[1]) for path in self._list(f"{self.folder}/manifests"))
        return [int(name[1]) for name in names if name]

    def _manifest(self, version: int | None = None) -> dict[str, dict]:
        number = self.version() if version is None else version
        if number == 0:
            return {}
        stream = self._files().open(self._path(self._manifest_path(number)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["tables"]
        finally:
            stream.close()

    def _publish(self, number: int, tables: dict[str, dict]) -> None:
        """Put the manifest of a version in place; the rename fails if the version exists."""
        final = self._path(self._manifest_path(number))
        aside = self._path(f"{self.folder}/manifests/.{uuid.uuid4().hex}.json")
        stream = self._files().create(aside, False)
        try:
            stream.write(bytearray(json.dumps({"version": number, "tables": tables}, indent=1, sort_keys=True).encode()))
        finally:
            stream.close()
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files().getUri(), self.spark._jsc.hadoopConfiguration())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = getattr(rename, "NONE")
        try:
            files.rename(self._files().makeQualified(aside), self._files().makeQualified(final), options)
        except Exception as failed:
            self._files().delete(aside, False)
            if "FileAlreadyExists" in str(failed):
                raise VersionConflict(f"version {number} exists already") from failed
            raise

    def _frame(self, name: str, entry: dict) -> DataFrame:
        schema = T.StructType.fromJson(entry["schema"])
        if not entry["folders"]:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.folder}/{folder}" for folder in entry["folders"].values()]
        known = T.StructType([*schema.fields, T.StructField(WRITE_ID, T.StringType())])
        return self.spark.read.schema(known).option("basePath", f"{self.folder}/data/{name}").parquet(*paths).drop(WRITE_ID)


class Change:
    """Tables that are written aside and become one version together.

    ``with store.change() as change`` publishes when the block ends and discards what was written if it
    fails. ``catalog`` reads what the change has so far, so tables can be derived from changed ones.
    """

    def __init__(self, store: TableStore):
        self.store = store
        self.base = store.version()
        self._tables = store._manifest(self.base)
        self._written: list[str] = []
        self._aside: list[str] = []

    def __enter__(self) -> "Change":
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.commit()
        else:
            self.discard()

    def read(self, name: str) -> DataFrame:
        return self.store._frame(name, self._tables[name])

    def tables(self) -> list[str]:
        return sorted(self._tables)

    def has(self, name: str) -> bool:
        return name in self._tables

    def folders(self, name: str) -> dict[str, str]:
        return dict(self._tables[name]["folders"])

    def aside(self, name: str, df: DataFrame) -> DataFrame:
        """Rows that several steps of the change read: computed once, and gone when it ends."""
        folders, schema = self._write(name, df, None)
        self._aside.append(folders[""])
        return self.store._frame(name, {"schema": json.loads(schema.json()), "folders": folders})

    def replace(self, name: str, df: DataFrame, day: str | None = None, laid: bool = False) -> DataFrame:
        """Write a whole table; with a date column it is stored by month. Returns the stored table.

        ``laid`` tells that the rows come from files by month, so that no shuffle has to bring them together.
        """
        folders, schema = self._write(name, df, day, laid)
        self._tables[name] = {"schema": json.loads(schema.json()), "day": day, "folders": folders}
        return self.read(name)

    def replace_months(self, name: str, df: DataFrame, months: Iterable[str | date], laid: bool = False) -> DataFrame:
        """Write some months of a table that is stored by month; the others keep their files.

        ``df`` holds the new rows of these months and may hold other rows, which are not looked at. A month
        without rows goes. ``laid`` is that of ``replace``. Returns the stored table.
        """
        entry = self._tables[name]
        if entry["day"] is None:
            raise ValueError(f"{name} is not stored by month")
        starts = sorted({period_bounds(month)[0] for month in months})
        if starts:
            own = df.where(month_start(F.col(entry["day"])).isin(starts))
            folders, _ = self._write(name, own.select(*self._columns(entry)), entry["day"], laid)
            kept = {m: f for m, f in entry["folders"].items() if m not in {s.isoformat() for s in starts}}
            self._tables[name] = {**entry, "folders": dict(sorted({**kept, **folders}.items()))}
        return self.read(name)

    def drop(self, name: str) -> None:
        self._tables.pop(name)

    def commit(self) -> int:
        """Publish; returns the number of the new version."""
        try:
            self.store._publish(self.base + 1, self._tables)
        except VersionConflict:
            self.discard()
            raise
        for folder in self._aside:
            self.store._delete(f"{self.store.folder}/{folder}")
        return self.base + 1

    def discard(self) -> None:
        """Delete what the change has written."""
        for folder in self._written:
            self.store._delete(f"{self.store.folder}/{folder}")

    @staticmethod
    def _columns(entry: dict) -> list[str]:
        return [f["name"] for f in entry["schema"]["fields"] if f["name"] != MONTH_KEY]

    def _write(self, name: str, df: DataFrame, day: str | None, laid: bool = False) -> tuple[dict[str, str], T.StructType]:
        folder = f"data/{name}/{WRITE_ID}={uuid.uuid4().hex}"
        path = f"{self.store.folder}/{folder}"
        self._written.append(folder)
        if day is None:
            df.write.option("compression", CODEC).parquet(path)
            return {"": folder}, df.schema
        dealt = df.withColumn(MONTH_KEY, month_start(F.col(day))) if laid else by_month(df, day)
        with _months_at_once(self.store.spark):
            dealt.write.option("compression", CODEC).partitionBy(MONTH_KEY).parquet(path)
        months = (p.rsplit("/", 1)[1] for p in self.store._list(path))
        found = {m.removeprefix(f"{MONTH_KEY}="): f"{folder}/{m}" for m in sorted(months) if m.startswith(f"{MONTH_KEY}=")}
        fields = [f for f in dealt.schema.fields if f.name != MONTH_KEY] + [dealt.schema[MONTH_KEY]]
        return found, T.StructType(fields)
