"""A stored catalogue that takes small upserts and point lookups: hash buckets under a manifest.

Rows are spread over a fixed number of buckets by a hash of the key. A bucket is one folder of Parquet
files; the manifest of a version says which folder each bucket has. An upsert reads and writes the buckets
that its keys fall into and no others, then writes a manifest that points to the new folders; a version
exists once its manifest's commit is done, so readers see all of an upsert or nothing. Folders of a
failed upsert are in no manifest; ``vacuum`` removes them with those of old versions.

One writer at a time. A numbered batch that is stored already is skipped, so a stream may repeat
it. Rows with a null key are kept in one bucket and replaced like any other key. Keys that a batch
repeats must be made one first (``ingest.newest``); a batch with repeated keys is refused.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantlake.sources.shared import cut_lineage, discard

BUCKETS = 64
MOST_BUCKETS = 65_536  # of a manifest, which the driver holds
MANIFEST = "buckets int, batch long, schema string, bucket int, folder string"


@dataclass(frozen=True)
class Manifest:
    version: int
    buckets: int
    schema: T.StructType
    folders: dict[int, str]
    batch: int | None = None


class KeyedStore:
    """Rows by key under ``path``."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id") -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def bucket(self, buckets: int, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(self.key if key is None else key), F.lit(buckets)).cast("int")

    # ---- manifests ----

    def _listed(self, folder: str) -> list[str]:
        """Names in a folder; none where there is no folder."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        system = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in system.listStatus(at)] if system.exists(at) else []

    def versions(self) -> list[int]:
        """Committed versions in order."""
        return sorted(int(v.split("=")[1]) for v in self._listed("manifest") if "_SUCCESS" in self._listed(f"manifest/{v}"))

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The manifest of a version, the last one by default; None where nothing is stored."""
        known = self.versions()
        if version is None and not known:
            return None
        version = known[-1] if version is None else version
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v={version}").collect()
        first = rows[0]
        return Manifest(version, first["buckets"], T.StructType.fromJson(json.loads(first["schema"])), {r["bucket"]: r["folder"] for r in rows if r["bucket"] is not None}, first["batch"])

    def _commit(self, m: Manifest) -> None:
        of = (m.buckets, m.batch, m.schema.json())
        rows = [(*of, b, f) for b, f in sorted(m.folders.items())] or [(*of, None, None)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={m.version}")

    # ---- reading ----

    def _rows(self, m: Manifest, buckets: list[int] | None = None) -> DataFrame:
        wanted = m.folders if buckets is None else {b: m.folders[b] for b in buckets if b in m.folders}
        if not wanted:
            return self.spark.createDataFrame([], m.schema)
        return self.spark.read.schema(m.schema).parquet(*[f"{self.path}/data/{folder}/bucket={b}" for b, folder in sorted(wanted.items())])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        if (m := self.manifest(version)) is None:
            raise ValueError(f"nothing is stored under {self.path}")
        return self._rows(m)

    def get(self, *keys: object) -> DataFrame:
        """The rows of some keys; only their buckets' files are opened, and the filter reaches these."""
        m = self.manifest()
        if m is None:
            raise ValueError(f"nothing is stored under {self.path}")
        asked = self.spark.createDataFrame([(k,) for k in keys], T.StructType([m.schema[self.key]]))
        buckets = [r[0] for r in asked.select(self.bucket(m.buckets)).distinct().collect()]
        found = self._rows(m, buckets)
        some = F.col(self.key).isin([k for k in keys if k is not None])
        return found.filter(some | F.col(self.key).isNull() if None in keys else some)

    def get_all(self, keys: DataFrame) -> DataFrame:
        """The rows of a table of keys; buckets without any of them stay closed."""
        m = self.manifest()
        if m is None:
            raise ValueError(f"nothing is stored under {self.path}")
        asked = keys.select(F.col(self.key).alias("_key")).distinct()
        buckets = [r[0] for r in asked.select(self.bucket(m.buckets, F.col("_key"))).distinct().collect()]
        return self._rows(m, buckets).join(asked, F.col(self.key).eqNullSafe(F.col("_key")), "left_semi")

    def page(self, after: object | None, size: int) -> DataFrame:
        """The next ``size`` rows by key behind ``after``; the first ones for None. Null keys are in no page."""
        rows = self.read().filter(F.col(self.key).isNotNull())
        return (rows if after is None else rows.filter(F.col(self.key) > after)).orderBy(self.key).limit(size)

    # ---- writing ----

    def upsert(self, new: DataFrame, batch: int | None = None, buckets: int = BUCKETS) -> Manifest:
        """Stores new rows, each in place of the row with its key. ``buckets`` counts for the first batch alone.

        Buckets' numbers reach the driver, at most ``MOST_BUCKETS``; rows don't.
        """
        if not 0 < buckets <= MOST_BUCKETS:
            raise ValueError(f"1 to {MOST_BUCKETS} buckets")
        m = self.manifest()
        if m and batch is not None and m.batch is not None and batch <= m.batch:
            return m
        m = m or Manifest(-1, buckets, T.StructType([T.StructField(f.name, f.dataType) for f in new.schema]), {})
        rows = cut_lineage(new.select(*m.schema.names).withColumn("bucket", self.bucket(m.buckets)))
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce(F.xxhash64(self.key), F.lit(0))).alias("keys")).collect()
        if any(r["n"] != r["keys"] for r in sizes) and rows.groupBy(self.key).count().filter("count > 1").limit(1).count():
            raise ValueError("a batch must have each key once")
        touched, folder = [r["bucket"] for r in sizes], f"v{m.version + 1}-{uuid.uuid4().hex[:8]}"
        if touched:
            old = self._rows(m, touched)
            mine = rows.select(F.col(self.key).alias("_key"))
            kept = old.join(mine, F.col(self.key).eqNullSafe(F.col("_key")), "left_anti").withColumn("bucket", self.bucket(m.buckets))
            kept.unionByName(rows).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        done = replace(m, version=m.version + 1, folders=m.folders | dict.fromkeys(touched, folder), batch=m.batch if batch is None else batch)
        self._commit(done)
        return done

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes manifests but the last ``keep``, and the bucket folders that none of these has. Returns what is gone."""
        known = self.versions()
        last = [self.manifest(v) for v in known[-max(1, keep) :]]
        needed = {(f, b) for m in last for b, f in m.folders.items()}
        gone = [f"manifest/v={v}" for v in known[: -max(1, keep)]]
        for folder in self._listed("data"):
            own = [n for n in self._listed(f"data/{folder}") if n.startswith("bucket=")]
            left = [n for n in own if (folder, int(n.split("=")[1])) not in needed]
            gone += [f"data/{folder}"] if len(left) == len(own) else [f"data/{folder}/{n}" for n in left]
        for name in gone:
            discard(self.spark, f"{self.path}/{name}")
        return gone

