"""Tables in versions: data files first, then one small manifest that readers follow.

A commit writes the new files of all tables that it changes and then puts the next manifest in place, which fails if another writer was first. Readers
open a version and read just its files: they see all of a commit or nothing of it, and one that was opened before a delete reads on until
``vacuum``. A commit has a batch name; a batch that is there already changes nothing, so a retried job is safe.

Rows are dealt to buckets by a column. A change of rows rewrites the buckets that hold them, all other files stay as they are.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer has put a version in place since this one was read; nothing was changed."""


class Tables:
    """The tables of one folder, as of its latest version when a call is made."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _list(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def version(self) -> int:
        """The latest version, 0 before the first commit."""
        return max((int(n[:-5]) for n in self._list("versions") if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """Tables of a version (the latest): schema, bucket column and the folders of each bucket; and the batches so far."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "batches": [], "tables": {}}
        at = f"{self.root}/versions/{version:09d}.json"
        return json.loads(self.spark.read.text(at, wholetext=True).first()[0])

    def has(self, name: str) -> bool:
        return name in self.manifest()["tables"]

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version (the latest). What is read later still is that version."""
        return self._read(self.manifest(version)["tables"][name])

    def _read(self, table: dict, only: set[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(table["schema"])
        folders = [f"{self.root}/{f}" for b, own in sorted(table["files"].items()) if only is None or b in only for f in own]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _bucket_of(self, by: str | None) -> Column:
        return F.pmod(F.xxhash64(F.col(by)), F.lit(self.buckets)).cast("string") if by else F.lit("0")

    def commit(self, batch: str, puts: dict[str, tuple[DataFrame, str | None]], removes: dict[str, tuple[DataFrame, list[str]]] | None = None) -> int:
        """Change several tables in one step; the version that has the change.

        ``puts``: rows to add and the column that buckets go by (for a table that is there, its own is kept). ``removes``: keys and the columns they are in; rows with
        these keys go, before rows are added. Columns that a table lacks are added with nulls, and rows may lack columns of their table.
        """
        old = self.manifest()
        if batch in old["batches"]:
            return old["version"]
        tables = dict(old["tables"])
        removes = removes or {}
        for name in {**puts, **removes}:
            if name in puts or name in tables:
                tables[name] = self._changed(tables.get(name), *puts.get(name, (None, None)), *removes.get(name, (None, [])))
        new = {"version": old["version"] + 1, "batches": [*old["batches"], batch], "tables": tables}
        self._place(new)
        return new["version"]

    def _changed(self, table: dict | None, rows: DataFrame | None, by: str | None, keys: DataFrame | None, on: list[str]) -> dict:
        by = table["by"] if table else by
        files = {b: list(own) for b, own in table["files"].items()} if table else {}
        stored = self._read(table) if table else None
        if keys is not None and table:
            keys = keys.select(*on).distinct()
            # A null key is a key here.
            same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in on]
            hit = stored.withColumn(_BUCKET, self._bucket_of(by))
            hit = {x[0] for x in hit.join(keys, same(hit, keys), "left_semi").select(_BUCKET).distinct().collect()}
            stay = self._read(table, hit)
            stay = stay.join(keys, same(stay, keys), "left_anti")
            rows = stay if rows is None else stay.unionByName(rows, allowMissingColumns=True)
            files = {b: own for b, own in files.items() if b not in hit}
        elif rows is None:
            return table
        schema = rows.schema
        if stored is not None:
            schema = stored.limit(0).unionByName(rows.limit(0), allowMissingColumns=True).schema
            rows = self.spark.createDataFrame([], schema).unionByName(rows, allowMissingColumns=True)
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn(_BUCKET, self._bucket_of(by)).repartition(self.buckets, _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.root}/{folder}")
        for part in self._list(folder):
            if part.startswith(f"{_BUCKET}="):
                files.setdefault(part.partition("=")[2], []).append(f"{folder}/{part}")
        return {"schema": json.loads(schema.json()), "by": by, "files": files}

    def _place(self, manifest: dict) -> None:
        """Write a manifest under a name of its own and rename it, which must not replace another."""
        jvm, folder = self.spark._jvm, f"{self.root}/versions"
        self._fs.mkdirs(self._path(folder))
        draft, final = self._path(f"{folder}/{uuid.uuid4().hex}.draft"), self._path(f"{folder}/{manifest['version']:09d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(final), options)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {manifest['version']} of {self.root} is there already") from None
            raise

    def staged(self, rows: DataFrame) -> DataFrame:
        """Rows written beside the tables and read back, for several steps of one change; they stay until ``vacuum``."""
        path = f"{self.root}/staging/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def vacuum(self, keep: int = 1) -> int:
        """Delete data that none of the last ``keep`` versions has; the number of folders. Not while others write."""
        last = self.version()
        used = {f for v in range(max(1, last - keep + 1), last + 1) for t in self.manifest(v)["tables"].values() for own in t["files"].values() for f in own}
        gone = 0
        for folder in self._list("data"):
            for part in self._list(f"data/{folder}"):
                if part.startswith(_BUCKET) and f"data/{folder}/{part}" not in used:
                    gone += self._fs.delete(self._path(f"{self.root}/data/{folder}/{part}"), True)
        self._fs.delete(self._path(f"{self.root}/staging"), True)
        for name in self._list("versions"):
            if name.endswith(".json") and int(name[:-5]) <= last - keep:
                self._fs.delete(self._path(f"{self.root}/versions/{name}"), False)
        return gone
