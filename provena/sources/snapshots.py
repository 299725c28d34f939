"""Keyed snapshots: a table of one row a key, merged in place of rewritten, and published by a manifest.

Rows lie in hash buckets of their key.  A merge reads the buckets that its batch touches, writes those whose rows differ to a folder of
its own, and publishes a manifest that names the newest folder of each bucket; until then readers see the old one, so
a write that fails leaves nothing behind that counts.  `created_at` is kept from a key's first row, `updated_at` and `run_id`
come from the merge that last changed it, so a second equal run changes no bucket.

Defined cases: of several rows of one key in a batch the last in the order of all columns counts; rows with a null in the key are refused; a property that is
null in the batch keeps its old value (`replace=True`: it is cleared); properties that a batch doesn't have stay; an empty batch publishes nothing;
two merges at a time: the second to publish fails, and may be run again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from provena.session import _files, discard

STAMPS = ("created_at", "updated_at", "run_id")


@dataclass(frozen=True)
class Manifest:
    version: int
    keys: tuple[str, ...]
    buckets: int
    schema: str  # JSON, without the bucket
    folders: dict[str, str]  # bucket: folder

    def json(self) -> str:
        return json.dumps(self.__dict__)


def _list(spark: SparkSession, root: str) -> dict[int, str]:
    fs, where = _files(spark, root)
    if not fs.exists(where):
        return {}
    names = [f.getPath().getName() for f in fs.listStatus(where)]
    return {int(n[9:-5]): f"{root}/{n}" for n in names if n.startswith("manifest-") and n.endswith(".json")}


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all; FileExistsError if it is there already."""
    fs, where = _files(spark, path)
    if fs.exists(where):
        raise FileExistsError(path)
    new = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.new")
    out = fs.create(new, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(where) or not fs.rename(new, where):
        fs.delete(new, False)
        raise FileExistsError(path)


def get_text(spark: SparkSession, path: str) -> str:
    fs, where = _files(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def manifest(spark: SparkSession, root: str, version: int | None = None) -> Manifest | None:
    """The newest manifest, or that of a version."""
    found = _list(spark, root)
    if not found:
        return None
    m = json.loads(get_text(spark, found[max(found) if version is None else version]))
    return Manifest(m["version"], tuple(m["keys"]), m["buckets"], m["schema"], m["folders"])


def _bucket(keys: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def _rows(spark: SparkSession, m: Manifest, buckets: list[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(m.schema))
    paths = [f"{folder}/bucket={b}" for b, folder in m.folders.items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """All rows of a snapshot, with their stamps."""
    m = manifest(spark, root, version)
    if m is None:
        raise FileNotFoundError(root)
    return _rows(spark, m)


def _publish(spark: SparkSession, root: str, old: Manifest | None, rows: DataFrame, keys: tuple[str, ...], buckets: int, changed: list[int]) -> Manifest:
    """Write the rows of the changed buckets and name them in a new manifest."""
    folder = f"{root}/data-{uuid.uuid4().hex[:12]}"
    mine = rows.withColumn("bucket", _bucket(keys, buckets)).where(F.col("bucket").isin(*changed))
    mine.repartition("bucket").sortWithinPartitions("bucket", *keys).write.partitionBy("bucket").parquet(folder)
    fs, where = _files(spark, folder)
    there = {f.getPath().getName().removeprefix("bucket=") for f in fs.listStatus(where) if f.isDirectory()}
    folders = {b: f for b, f in (old.folders if old else {}).items() if int(b) not in changed} | dict.fromkeys(sorted(there), folder)
    m = Manifest((old.version + 1) if old else 1, keys, buckets, rows.schema.json(), folders)
    put_text(spark, f"{root}/manifest-{m.version:09d}.json", m.json())
    return m


def merge(new: DataFrame, root: str, keys: list[str], run_id: str, now: Column | None = None, buckets: int = 64, replace: bool = False) -> int:
    """Upsert the batch `new`; the version that holds it."""
    spark, old = new.sparkSession, manifest(new.sparkSession, root)
    keys, buckets = (old.keys, old.buckets) if old else (tuple(keys), buckets)
    now = F.current_timestamp() if now is None else now
    if new.where(" OR ".join(f"`{k}` IS NULL" for k in keys)).limit(1).collect():
        raise ValueError(f"null in the key {', '.join(keys)}")
    props = [c for c in new.columns if c not in keys and c not in STAMPS]
    one = new.groupBy(*keys).agg(F.max(F.struct(*props)).alias("p")).select(*keys, "p.*") if props else new.select(*keys).distinct()
    if old:  # a key of another type would hash into another bucket
        kinds = {f.name: f.dataType for f in T.StructType.fromJson(json.loads(old.schema))}
        one = one.withColumns({k: F.col(k).cast(kinds[k]) for k in keys})
    touched = [r[0] for r in one.select(_bucket(keys, buckets)).distinct().collect()]  # as many numbers as buckets at most
    if not touched:
        return old.version if old else 0
    stamp = [now.cast("timestamp").alias("_now"), F.lit(run_id).alias("_run")]
    if old is None:
        rows = one.select("*", *stamp).select(*keys, *props, F.col("_now").alias("created_at"), F.col("_now").alias("updated_at"), F.col("_run").alias("run_id"))
        return _publish(spark, root, None, rows, keys, buckets, touched).version
    was = _rows(spark, old, touched)
    gone = [c for c in was.columns if c not in keys and c not in props and c not in STAMPS]
    before = was.select(*[F.col(k).alias(f"k_{k}") for k in keys], F.struct(*[c for c in was.columns if c not in keys]).alias("o"))
    on = [F.col(k) == F.col(f"k_{k}") for k in keys]
    x = one.withColumn("_new", F.lit(True)).join(before, on, "full")
    key = [F.coalesce(k, f"k_{k}").alias(k) for k in keys]
    had = set(was.columns)
    value = lambda p: (F.col(p) if replace else F.coalesce(F.col(p), F.col(f"o.{p}"))) if p in had else F.col(p)
    differs = F.lit(False)
    for p in props:
        differs = differs | ~(value(p).eqNullSafe(F.col(f"o.{p}")) if p in had else F.col(p).isNull())
    changed = F.coalesce(F.col("_new"), F.lit(False)) & (F.col("o").isNull() | differs)
    x = x.withColumn("_changed", changed).select(
        *key, *[F.when(F.coalesce("_new", F.lit(False)), value(p)).otherwise(F.col(f"o.{p}") if p in had else F.lit(None)).alias(p) for p in props], *[F.col(f"o.{c}").alias(c) for c in gone],
        F.coalesce(F.col("o.created_at"), now.cast("timestamp")).alias("created_at"), F.when(F.col("_changed"), now.cast("timestamp")).otherwise(F.col("o.updated_at")).alias("updated_at"),
        F.when(F.col("_changed"), F.lit(run_id)).otherwise(F.col("o.run_id")).alias("run_id"), "_changed")
    dirty = [r[0] for r in x.where("_changed").select(_bucket(keys, buckets)).distinct().collect()]
    if not dirty:
        return old.version
    everything = x.drop("_changed")
    fresh = [c for c in everything.columns if c not in had]
    if fresh:  # rows of other buckets have the new properties as null
        return _publish(spark, root, old, everything, keys, buckets, dirty).version
    return _publish(spark, root, old, everything.select(*was.columns), keys, buckets, dirty).version


def remove(spark: SparkSession, root: str, condition: Column) -> int:
    """Take out the rows for which the condition is true; the version without them."""
    m = manifest(spark, root)
    if m is None:
        raise FileNotFoundError(root)
    rows = _rows(spark, m)
    hit = F.coalesce(condition, F.lit(False))
    dirty = [r[0] for r in rows.where(hit).select(_bucket(m.keys, m.buckets)).distinct().collect()]
    if not dirty:
        return m.version
    return _publish(spark, root, m, _rows(spark, m, dirty).where(~hit), m.keys, m.buckets, dirty).version


def reset_run(spark: SparkSession, root: str, run_id: str, edges: str | None = None, ends: tuple[str, ...] = ("from_key", "to_key"), key: str = "key") -> tuple[int, int | None]:
    """Take out the rows that a run wrote last, and the rows of the snapshot `edges` that end in one of them; both versions.

    An edge's end is looked up by a join with the removed keys, whose number is the run's own.
    """
    lost = read(spark, root).where(F.col("run_id") == run_id).select(F.col(key).alias("_lost")).distinct()
    cut = None
    if edges is not None:
        m = manifest(spark, edges)
        rows = _rows(spark, m)
        for e in ends:
            rows = rows.join(lost.select(F.col("_lost").alias(f"_{e}")), F.col(e) == F.col(f"_{e}"), "left")
        dead = rows.where(" OR ".join(f"_{e} IS NOT NULL" for e in ends)).select(*m.keys)
        dirty = [r[0] for r in dead.select(_bucket(m.keys, m.buckets)).distinct().collect()]
        cut = m.version
        if dirty:
            cut = _publish(spark, edges, m, _rows(spark, m, dirty).join(dead.distinct(), list(m.keys), "left_anti").select(*_rows(spark, m).columns), m.keys, m.buckets, dirty).version
    return remove(spark, root, F.col("run_id") == run_id), cut


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Remove manifests but the newest `keep`, and the data folders that none of these names; how many folders went."""
    found = _list(spark, root)
    live = sorted(found)[-keep:]
    named = {f for v in live for f in manifest(spark, root, v).folders.values()}
    for v in set(found) - set(live):
        discard(spark, found[v])
    fs, where = _files(spark, root)
    gone = [f"{root}/{f.getPath().getName()}" for f in fs.listStatus(where) if f.isDirectory() and f.getPath().getName().startswith("data-")]
    gone = [p for p in gone if p not in named]
    for p in gone:
        discard(spark, p)
    return len(gone)
