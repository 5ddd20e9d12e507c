"""A keyed table with versions: upserts and deletes rewrite the buckets they touch, a log of manifests says what is whole."""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, _parse_datatype_string

BUCKETS = 32
#: Tasks that write a bucket, at most.
SHARES = 8


class Store:
    """Rows of one schema, one for each key (its columns may be null), in a folder that all executors see.

    Rows lie in buckets by a hash of their key. A change writes new files for the buckets that it touches, then publishes a
    manifest, the next number of a log, that names the folder of every bucket: readers see a version whole or not at all,
    and what a writer left behind when it failed in between is named by none. A manifest is published only if its number
    is free. A writer that finds it taken keeps its files where the others touched other buckets, and merges anew where
    they touched its own; so no change is lost. A manifest grows with the number of buckets, not of rows or files.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str | StructType, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
        self._log = f"{self.path}/_log"
        self._jvm = spark._jvm
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    # --- the log

    def versions(self) -> list[int]:
        """Numbers of the versions there are, ascending; 0, the empty table, isn't among them."""
        if not self._fs.exists(self._at(self._log)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self._log))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """What a version (the latest) consists of."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "buckets": self.buckets, "folders": {}, "batches": {}}
        at = self._at(f"{self._log}/{version:020d}.json")
        if not self._fs.exists(at):
            raise ValueError(f"there is no version {version}")
        with_ = self._fs.open(at)
        try:
            read = json.loads(bytes(with_.readAllBytes()).decode())
        finally:
            with_.close()
        if read["buckets"] != self.buckets:
            raise ValueError(f"the table has {read['buckets']} buckets")
        return read

    def _publish(self, manifest: dict) -> bool:
        """Put a manifest under its number in one step, unless the number is taken."""
        to = self._at(f"{self._log}/{manifest['version']:020d}.json")
        made = self._at(f"{self._log}/.{uuid.uuid4().hex}")
        out = self._fs.create(made)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":
                # a local rename would replace the file; a link doesn't
                local = lambda p: unquote(urlparse(p.toUri().toString()).path)
                try:
                    os.link(local(made), local(to))
                except FileExistsError:
                    return False
                return True
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
            kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
            how = self.spark._sc._gateway.new_array(kind, 1)
            how[0] = kind.NONE
            try:
                context.rename(made, to, how)
            except Exception:
                if self._fs.exists(to):
                    return False
                raise
            return True
        finally:
            self._fs.delete(made, False)

    # --- rows

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        folders = {int(b): f for b, f in manifest["folders"].items()}
        paths = [f"{self.path}/{folders[b]}/bucket={b}" for b in sorted(folders if buckets is None else set(folders) & set(buckets))]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default of the latest; files of older versions stay until `vacuum`."""
        return self._read(self.manifest(version))

    def _same(self, a: str, b: str) -> Column:
        out = F.lit(True)
        for k in self.keys:
            out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
        return out

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows in the tasks that write their bucket: a bucket is SHARES tasks' work, so that few buckets don't hold up a
        large table."""
        rows = rows.withColumns({"bucket": self._bucket(), "__share": F.pmod(F.xxhash64(F.lit(1), *self.keys), F.lit(SHARES)).cast("int")})
        return rows.repartition("bucket", "__share")

    def _change(self, rows: DataFrame, merged, batch: tuple[str, int] | None) -> int:
        touched = sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())
        head = self.manifest()
        while True:
            if batch and head["batches"].get(batch[0], -1) >= batch[1]:
                return head["version"]
            base, folder = head, f"data/{uuid.uuid4().hex}"
            merged(self._read(base, touched), rows).drop("__share").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            there = {s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/{folder}"))}
            own = {str(b): folder for b in touched if f"bucket={b}" in there}  # a bucket without rows has no folder
            while True:
                folders = {b: f for b, f in head["folders"].items() if int(b) not in touched} | own
                batches = head["batches"] | ({batch[0]: batch[1]} if batch else {})
                if self._publish({"version": head["version"] + 1, "buckets": self.buckets, "folders": folders, "batches": batches}):
                    return head["version"] + 1
                head = self.manifest()
                if batch and head["batches"].get(batch[0], -1) >= batch[1]:
                    return head["version"]
                if any(head["folders"].get(str(b)) != base["folders"].get(str(b)) for b in touched):
                    break  # others changed these buckets meanwhile: merge into what they made

    def upsert(self, rows: DataFrame, carry: dict[str, Column] | None = None, newest: Column | None = None, batch: tuple[str, int] | None = None) -> int:
        """Put rows in place of those with their keys; the version that this makes.

        `carry` gives columns that depend on both, as expressions over `old` (null where there was none) and `new`. Of rows
        that share a key the one with the largest `newest` is put, ties by a hash of the row. `batch` (name, number) makes
        a change of a stream count once: a number that isn't above the last one of that name changes nothing.

        Old and new rows of a key meet in one grouping, dealt as the buckets are written: one shuffle.
        """
        names = self.schema.fieldNames()
        rows = rows.select(*[F.col(n).cast(self.schema[n].dataType).alias(n) for n in names], (F.lit(0) if newest is None else newest).alias("__newest"))

        def merged(old: DataFrame, new: DataFrame) -> DataFrame:
            whole, none, put = F.struct(*names), F.lit(None).cast(self.schema), F.col("new").isNotNull()
            # maps have no hash
            row = F.xxhash64(*[F.to_json(n) if isinstance(self.schema[n].dataType, ArrayType | MapType | StructType) else F.col(n) for n in names])
            new = new.select(*self.keys, none.alias("old"), whole.alias("new"), F.struct("__newest", F.bitwise_not(row).alias("__row")).alias("__place"))
            old = old.select(*self.keys, whole.alias("old"), none.alias("new"), F.lit(None).cast(new.schema["__place"].dataType).alias("__place"))
            both = self._dealt(old.unionByName(new)).groupBy("bucket", "__share", *self.keys).agg(F.first("old", ignorenulls=True).alias("old"), F.max_by("new", "__place").alias("new"))
            own = {n: (carry or {}).get(n, F.col(f"new.{n}")) for n in names}
            return both.select("bucket", *[F.when(put, own[n]).otherwise(F.col(f"old.{n}")).cast(self.schema[n].dataType).alias(n) for n in names])

        return self._change(rows, merged, batch)

    def delete(self, keys: DataFrame, where: Column | None = None) -> int:
        """Remove the rows with these keys, of them those that `where` (over the table's columns) holds for."""
        doomed = keys.select(*self.keys).distinct()

        def merged(old: DataFrame, gone: DataFrame) -> DataFrame:
            old = old.withColumn("__doomed", F.lit(True) if where is None else F.coalesce(where, F.lit(False)))
            return old.alias("old").join(gone.alias("gone"), self._same("old", "gone") & F.col("old.__doomed"), "left_anti").drop("__doomed").transform(self._dealt)

        return self._change(doomed, merged, None)

    def changes(self, old: int, new: int | None = None) -> DataFrame:
        """Rows that differ between two versions, with `change`: added, removed or changed; only buckets whose files
        differ are read. A changed row is the new one."""
        a, b = self.manifest(old), self.manifest(new)
        differ = [int(k) for k in set(a["folders"]) | set(b["folders"]) if a["folders"].get(k) != b["folders"].get(k)]
        names = self.schema.fieldNames()
        left = self._read(a, differ).withColumn("__has", F.lit(True)).alias("old")
        both = left.join(self._read(b, differ).withColumn("__has", F.lit(True)).alias("new"), self._same("old", "new"), "full")
        same = F.to_json(F.struct(*[f"old.{n}" for n in names])) == F.to_json(F.struct(*[f"new.{n}" for n in names]))
        change = F.when(F.col("old.__has").isNull(), "added").when(F.col("new.__has").isNull(), "removed").when(~same, "changed")
        picked = [F.when(F.col("new.__has").isNull(), F.col(f"old.{n}")).otherwise(F.col(f"new.{n}")).alias(n) for n in names]
        return both.withColumn("change", change).where("change IS NOT NULL").select(*picked, "change")

    def vacuum(self, keep: int = 1) -> int:
        """Delete the manifests but the last `keep`, and the folders that none of those names; how many folders went.
        For when nothing is being written or read."""
        versions = self.versions()
        live = {f for v in versions[-keep:] for f in self.manifest(v)["folders"].values()}
        for v in versions[:-keep]:
            self._fs.delete(self._at(f"{self._log}/{v:020d}.json"), False)
        data = self._at(f"{self.path}/data")
        gone = [s.getPath() for s in self._fs.listStatus(data) if f"data/{s.getPath().getName()}" not in live] if self._fs.exists(data) else []
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)
