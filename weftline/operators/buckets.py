"""Tables in hash buckets of their keys: changes rewrite the buckets that they touch, look-ups open the buckets of their keys.

Layout under ``path``: ``data/<version>/b=<bucket>/*.parquet``, rows sorted by the key columns, with Parquet bloom filters on them;
``manifest/<number>.json`` with the versions of every bucket. A write adds a version and publishes it by one rename of a new manifest. A
reader takes the newest manifest and never sees a part of a write; a writer that is lost before the rename has changed nothing.
There is one writer at a time: the rename of a second one fails.

* ``append`` adds files beside the others of a bucket; ``replace`` rewrites touched buckets; ``compact`` merges buckets of many versions.
* Old versions stay until ``vacuum``, for readers that still use them.
* The number of buckets is the manifest's; ``rebucket`` changes it. Large buckets are written by several tasks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kv

#: Keys of a look-up that are named in the filter of the scan.
FEW = 200


class BucketStore:
    """A table ``schema`` under ``path``. ``keys`` are SQL expressions over its columns; equal keys share a bucket. ``identity``: the columns that
    a replaced row is known by, if there are more of them than the keys; keys are then expressions over these."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], identity: tuple[str, ...] | None = None, buckets: int = 64):
        self.spark, self.path, self.keys, self.identity, self.buckets = spark, path.rstrip("/"), keys, identity or keys, buckets
        self._fs, self._to_path = kv._files(spark, self.path)
        empty = spark.createDataFrame([], schema)
        self.columns, self._key_types = empty.schema, [f.dataType for f in empty.select(*(F.expr(k) for k in keys)).schema]

    # Manifests

    def _manifests(self) -> list[str]:
        folder = self._to_path(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json") and not s.getPath().getName().startswith("_"))

    def manifest(self) -> dict:
        """{"buckets": n, "data": {bucket: [versions]}, "number": k} of the newest manifest."""
        names = self._manifests()
        if not names:
            return {"buckets": self.buckets, "data": {}, "number": 0}
        stream = self._fs.open(self._to_path(f"{self.path}/manifest/{names[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, before: dict, buckets: int, data: dict[str, list[str]]) -> None:
        number = before["number"] + 1
        new = json.dumps({"buckets": buckets, "data": {b: v for b, v in data.items() if v}, "number": number})
        temp, final = (self._to_path(f"{self.path}/manifest/{name}.json") for name in (f"_{uuid.uuid4().hex}", f"{number:012d}"))
        out = self._fs.create(temp)
        try:
            out.write(bytearray(new.encode()))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(temp, final):
            self._fs.delete(temp, False)
            raise RuntimeError(f"another writer has changed {self.path}")

    # Reading

    def bucket_of(self, *columns: Column | str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")

    def _open(self, m: dict, buckets: list[int] | None = None) -> DataFrame:
        live = {int(b): v for b, v in m["data"].items()}
        wanted = sorted(live) if buckets is None else [b for b in sorted(set(buckets)) if b in live]
        held: dict[str, list[int]] = {}
        for b in wanted:
            for v in live[b]:
                held.setdefault(v, []).append(b)
        folders = [f"{self.path}/data/{v}/b={b}" for v, bs in held.items() for b in bs]
        if not folders:
            return self.spark.createDataFrame([], self.columns)
        return self.spark.read.schema(self.columns).option("recursiveFileLookup", "true").parquet(*folders)

    def read(self) -> DataFrame:
        return self._open(self.manifest())

    def near(self, keys: DataFrame, columns: tuple[str, ...] | None = None, made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """The rows with the given keys (columns named as in ``columns``, or as the key columns), from their buckets only.

        A few keys are named in the scan's filter, where row groups are left out by their range and bloom filter. ``made``: an aggregate of the rows by
        their keys, which is then what the keys pick from, so that many rows are counted where they lie instead of being joined.
        """
        names = list(columns or self.keys)
        m = self.manifest()
        asked = keys.select(*(F.col(c).cast(t).alias(c) for c, t in zip(names, self._key_types, strict=True))).dropna().distinct()
        few = asked.limit(FEW + 1).collect()
        if not few or not m["data"]:
            return made(self._open(m, [])) if made else self._open(m, [])
        if len(few) <= FEW:
            asked = self.spark.createDataFrame(few, asked.schema)
        in_bucket = asked.select(self.bucket_of(*names, buckets=m["buckets"]).alias("b"))
        touched = [r["b"] for r in (in_bucket if len(few) <= FEW else in_bucket.distinct()).collect()]  # FEW rows, or one for each bucket
        rows = made(self._open(m, touched)) if made else self._open(m, touched)
        on = [F.expr(k) == F.col(f"__k{i}") for i, k in enumerate(self.keys)]
        if len(few) <= FEW:
            for i, k in enumerate(self.keys):
                rows = rows.filter(F.expr(k).isin([r[i] for r in few]))
        asked = asked.select(*(F.col(n).alias(f"__k{i}") for i, n in enumerate(names)))
        return rows.join(F.broadcast(asked) if len(few) <= FEW else asked, on, "left_semi")  # FEW rows

    # Writing

    def _write(self, rows: DataFrame, buckets: int) -> tuple[str, list[int]]:
        """(version, its buckets)"""
        version = uuid.uuid4().hex
        rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.columns))
        rows = rows.withColumn("b", self.bucket_of(*(F.expr(k) for k in self.keys), buckets=buckets))
        plain = [k for k in self.keys if k in self.columns.names]
        # Small buckets share a task, a large one is split among several.
        writer = rows.hint("rebalance", F.col("b")).sortWithinPartitions("b", *plain).write
        for k in plain:
            writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
        writer.partitionBy("b").parquet(f"{self.path}/data/{version}")
        folder = self._to_path(f"{self.path}/data/{version}")
        return version, [int(s.getPath().getName()[2:]) for s in self._fs.listStatus(folder) if s.getPath().getName().startswith("b=")]

    def append(self, rows: DataFrame) -> None:
        """Add rows; no file is rewritten."""
        m = self.manifest()
        version, touched = self._write(rows, m["buckets"])
        data = dict(m["data"])
        for b in touched:
            data[str(b)] = [*data.get(str(b), []), version]
        self._publish(m, m["buckets"], data)

    def replace(self, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Rows known by ``gone`` (the identity columns), and those known as the new rows are, make way for the new rows. Only their buckets
        are rewritten."""
        m = self.manifest()
        n = m["buckets"]
        same = lambda df: df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.columns))
        known = [f for f in self.columns if f.name in self.identity]
        out = same(rows).select(*(f.name for f in known))
        if gone is not None:
            out = out.unionByName(gone.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in known)))
        touched = [r["b"] for r in out.select(self.bucket_of(*(F.expr(k) for k in self.keys), buckets=n).alias("b")).distinct().collect()]
        if not touched:
            return
        every = same(rows)
        if any(str(b) in m["data"] for b in touched):  # else there is nothing that could stay
            every = same(self._open(m, touched).join(out, [f.name for f in known], "left_anti")).unionByName(every)
        version, made = self._write(every, n)
        data = dict(m["data"]) | {str(b): [version] if b in made else [] for b in touched}
        self._publish(m, n, data)

    def overwrite(self, rows: DataFrame, buckets: int | None = None) -> None:
        """All rows anew, in another number of buckets if one is given."""
        m = self.manifest()
        n = buckets or m["buckets"]
        version, made = self._write(rows, n)
        self._publish(m, n, {str(b): [version] for b in made})

    def rebucket(self, buckets: int) -> None:
        self.overwrite(self.read(), buckets)

    def compact(self, versions: int = 8) -> int:
        """Merge the files of buckets with more than ``versions`` versions; how many there were."""
        m = self.manifest()
        many = [int(b) for b, v in m["data"].items() if len(v) > versions]
        if many:
            version, made = self._write(self._open(m, many), m["buckets"])
            self._publish(m, m["buckets"], dict(m["data"]) | {str(b): [version] if b in made else [] for b in many})
        return len(many)

    def vacuum(self) -> int:
        """Delete versions and manifests that the newest manifest does not name; for when no reader uses them. How many versions went."""
        m, folder = self.manifest(), self._to_path(f"{self.path}/data")
        live = {v for versions in m["data"].values() for v in versions}
        gone = [s.getPath() for s in self._fs.listStatus(folder) if s.getPath().getName() not in live] if self._fs.exists(folder) else []
        for p in gone:
            self._fs.delete(p, True)
        for name in self._manifests()[:-1]:
            self._fs.delete(self._to_path(f"{self.path}/manifest/{name}"), False)
        return len(gone)
