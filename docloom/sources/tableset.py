"""Several tables that change together: versions in folders, and a manifest, written last, that says which are in force."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.latest import delete, last_n, upsert


class Conflict(RuntimeError):
    """Another writer has put its manifest first."""


class TableSet:
    """Tables under one root. ``commit`` writes new versions of some, then one manifest; until that is in place, readers see
    the versions before, all of them. Manifests are numbered files; the next number can be taken once, by a rename.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/_manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self) -> dict:
        """number, tables (name to folder) and batches (ids of batches that are in) of the newest manifest."""
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "tables": {}, "batches": []}
        path = f"{self.root}/_manifests/{numbers[-1]}.json"
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.manifest()["tables"][name])

    def commit(self, changes: dict[str, Callable[[DataFrame | None], DataFrame]], batch: str | None = None, kept_batches: int = 1000) -> int:
        """Apply changes, each from a table's rows (None if there is none yet) to its new rows, as one; the manifest's number.

        A batch that is in already changes nothing. A failure leaves folders that no manifest names and all tables as they
        were. If another writer was first, Conflict is raised and nothing changed; call again.
        """
        before = self.manifest()
        if batch is not None and batch in before["batches"]:
            return before["number"]
        tables = dict(before["tables"])
        for name, change in changes.items():
            old = self.spark.read.parquet(tables[name]) if name in tables else None
            path = f"{self.root}/{name}/{uuid.uuid4().hex}"
            change(old).write.parquet(path)
            tables[name] = path
        number = before["number"] + 1
        batches = [*before["batches"], *([batch] if batch is not None else [])][-kept_batches:]
        self._publish(number, json.dumps({"number": number, "tables": tables, "batches": batches}))
        return number

    def _publish(self, number: int, text: str) -> None:
        folder = self._path(f"{self.root}/_manifests")
        self._fs.mkdirs(folder)
        draft, final = self._path(f"{self.root}/_manifests/{uuid.uuid4().hex}.draft"), self._path(f"{self.root}/_manifests/{number}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"manifest {number} is taken")

    def put(self, name: str, rows: DataFrame, keys: list[str], order: list[Column], batch: str | None = None) -> int:
        """Upsert rows into a table, latest wins."""
        return self.commit({name: lambda old: last_n(rows, keys, order, 1) if old is None else upsert(old, rows, keys, order)}, batch)

    def delete_documents(self, ids: DataFrame, tables: dict[str, str], batch: str | None = None) -> int:
        """Rows of some documents vanish from all tables at once; tables: name to the column that holds the document's id."""

        def change(column: str) -> Callable[[DataFrame | None], DataFrame]:
            def apply(old: DataFrame | None) -> DataFrame:
                if old is None:
                    raise KeyError("there is no such table yet")
                return delete(old, ids.select(F.col(ids.columns[0]).alias(column)), column)

            return apply

        return self.commit({name: change(column) for name, column in tables.items()}, batch)
