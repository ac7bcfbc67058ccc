"""Several tables that change together: a version names the files of all of them, and appears at once.

Tables are written first, under names that nobody reads; then one small file,
the version's manifest, is created, which fails if it exists.  Readers follow
a manifest, so they see all tables of one version or none, and a reader that
has begun stays with its version.  A writer that fails leaves files that no
manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


class Conflict(RuntimeError):
    """Another writer has made the version that this one was to be."""


@dataclass(frozen=True)
class Version:
    """What one manifest holds: the parts of each table, and notes."""

    number: int
    tables: dict[str, list[str]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)


class Store:
    """Tables below one folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at, files = self._path("versions")
        names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version:
        """A version, or the newest; before the first, an empty one of number 0."""
        have = self.versions()
        if number is None:
            number = have[-1] if have else 0
        if number == 0:
            return Version(0)
        if number not in have:
            raise ValueError(f"no version {number}")
        text = self.spark.read.text(f"{self.folder}/versions/{number:08d}.json", wholetext=True).first()["value"]
        held = json.loads(text)
        return Version(number, held["tables"], held["schemas"], held["notes"])

    def read(self, name: str, version: Version | None = None) -> DataFrame | None:
        """A table as of a version (the newest, if none is given); None where the version has no such table."""
        version = version or self.version()
        if name not in version.tables:
            return None
        schema = T.StructType.fromJson(json.loads(version.schemas[name]))
        parts = [f"{self.folder}/data/{p}" for p in version.tables[name]]
        return self.spark.read.schema(schema).parquet(*parts)

    def commit(self, tables: dict[str, DataFrame | Callable[[], DataFrame]], after: Version | None = None, append: bool = True, notes: dict | None = None) -> Version:
        """Writes the tables and makes the next version of them; others stay as they are.

        Tables may be functions, called in order, so that later ones can read
        what earlier ones have written (``staged``).  Conflict, if the version
        after ``after`` exists by then.
        """
        after = after or self.version()
        parts, schemas = {k: list(v) for k, v in after.tables.items()}, dict(after.schemas)
        for name, rows in tables.items():
            rows = rows() if callable(rows) else rows
            part = f"{name}/{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.folder}/data/{part}")
            parts[name] = [*(parts.get(name, []) if append else []), part]
            schemas[name] = rows.schema.json()
        made = Version(after.number + 1, parts, schemas, {**after.notes, **(notes or {})})
        self._publish(made)
        return made

    def _publish(self, version: Version) -> None:
        at, files = self._path(f"versions/{version.number:08d}.json")
        text = json.dumps({"tables": version.tables, "schemas": version.schemas, "notes": version.notes}, sort_keys=True)
        try:
            out = files.create(at, False)
        except Exception as e:
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version.number} exists") from e
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def staged(self, rows: DataFrame, name: str = "staged") -> DataFrame:
        """The rows written once outside of any version, and read back: what is made from them agrees."""
        path = f"{self.folder}/data/{name}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)


def write_bundle(store: Store, stream: str = "attempts", ident: str = "attempt_id", order: tuple[str, ...] = ("at",)) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: attempts, their events and summaries as one version for each batch.

    Of an id's rows in a batch the first in order stays, ids that are stored
    already are left out, and a batch that a version already holds does
    nothing.
    """
    from .sinks import bundle

    def write(batch: DataFrame, number: int) -> None:
        now = store.version()
        done = now.notes.get("batches", {})
        if done.get(stream, -1) >= number:
            return
        rank = F.row_number().over(Window.partitionBy(ident).orderBy(*[F.asc_nulls_last(c) for c in order], F.xxhash64(*[F.col(c) for c in batch.columns if not isinstance(batch.schema[c].dataType, T.MapType)])))
        rows = batch.withColumn("_n", rank).where("_n = 1").drop("_n")
        stored = store.read("attempts", now)
        if stored is not None:
            rows = rows.join(stored.select(ident), ident, "left_anti").select(*batch.columns)
        store.commit(bundle(store.staged(rows)), now, notes={"batches": {**done, stream: number}})

    return write
