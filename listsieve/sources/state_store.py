"""The state on shared storage: bucketed snapshots, committed one after the other.

State and crawl cache are parquet tables bucketed by their key, each bucket a folder of its own.
A merge then shuffles only its batch to the buckets; the state is read where it lies, and only
buckets that the batch touches are written anew. A version is a manifest that says where each
bucket lies, so versions share the buckets that did not change.

Writers do not lock. Each writes its buckets aside and then claims the number after the version
that its rows derive from, by a file that is put in place only where none is. Who comes second
gets ``Conflict`` and does its merge again on the newer version (``update``); nothing is lost, and
a lost executor or driver leaves the last version valid. The claim needs a file system that
renames without replacing, as HDFS does, or a local one.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listsieve import schema as sc
from listsieve.operators.enrich import unexpired
from listsieve.operators.lookup import as_time
from listsieve.operators.merge import RETENTION_DAYS, retain
from listsieve.sources.json_objects import object_entries, text_entries

BUCKETS = 64
#: Merges are tried so often before a writer gives up.
ATTEMPTS = 20
BUCKET = "bucket"


class Conflict(RuntimeError):
    """Another writer has committed since the rows were read."""


@dataclass
class Manifest:
    """A version: for each table, its buckets by the folder that holds them.

    ``streams``: the last batch that was taken in of each stream; ``batches``: names of batches
    without a number; ``as_of``: the moment of the last merge, which retention goes by;
    ``profile``: what the state was last purged by.
    """

    version: int
    tables: dict[str, dict[str, list[int]]] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)
    batches: list[str] = field(default_factory=list)
    as_of: str | None = None
    days: int = RETENTION_DAYS
    profile: str | None = None

    def has(self, batch: str) -> bool:
        stream, number = numbered(batch)
        return batch in self.batches if number is None else self.streams.get(stream, -1) >= number

    def take(self, batch: str) -> None:
        stream, number = numbered(batch)
        if number is not None:
            self.streams[stream] = number
        elif batch:
            self.batches.append(batch)

    def place(self, table: str, folder: str, written: Iterable[int], touched: Iterable[int]) -> None:
        """The touched buckets now lie in ``folder``, as far as they have rows."""
        gone = set(touched)
        kept = {f: [b for b in buckets if b not in gone] for f, buckets in self.tables.get(table, {}).items()}
        self.tables[table] = {f: b for f, b in {**kept, folder: sorted(written)}.items() if b}

    def folders(self) -> set[tuple[str, str, int]]:
        return {(t, f, b) for t, held in self.tables.items() for f, buckets in held.items() for b in buckets}


def numbered(batch: str) -> tuple[str, int | None]:
    """A stream's batches come one after the other: ``<stream>-<number>``."""
    stream, _, number = batch.rpartition("-")
    return (stream, int(number)) if stream and number.isdigit() else (batch, None)


class StateStore:
    """State and crawl cache under one folder.

    ``buckets`` fixes the layout when the store is first written: about a gigabyte or
    less of state per bucket. The number is kept beside the versions; a store that is
    opened again finds it there, and another number is refused.
    """

    KEYS = {"state": ("id", sc.STATE), "crawled": ("url", sc.CRAWLED)}

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self._tag = hashlib.sha1(self.path.encode()).hexdigest()[:12]
        self._seen: int | None = None  # the version it was last read at; -1: there was none
        kept = self._kept_buckets()
        if kept is not None and buckets not in (None, kept):
            raise ValueError(f"{self.path} is laid out in {kept} buckets, not {buckets}")
        self.buckets = kept or buckets or BUCKETS

    # -- files --------------------------------------------------------------------

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _names(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []

    def _delete(self, path: str) -> None:
        fs, where = self._fs(path)
        fs.delete(where, True)

    def _text(self, path: str) -> str:
        fs, where = self._fs(path)
        stream = fs.open(where)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put_new(self, path: str, text: str) -> bool:
        """Put a whole file in place, unless there is one."""
        folder, _, name = path.rpartition("/")
        fs, where = self._fs(path)
        fs.mkdirs(where.getParent())
        aside = f"{folder}/.{name}-{uuid.uuid4().hex}"
        if fs.getUri().getScheme() == "file":
            local = self._fs(aside)[1].toUri().getPath()
            with open(local, "w", encoding="utf-8") as out:
                out.write(text)
            try:
                os.link(local, where.toUri().getPath())
            except FileExistsError:
                return False
            finally:
                os.unlink(local)
            return True
        out = fs.create(self._fs(aside)[1], False)
        out.write(bytearray(text.encode()))
        out.close()
        placed = not fs.exists(where) and bool(fs.rename(self._fs(aside)[1], where))
        if not placed:
            self._delete(aside)
        return placed

    def _kept_buckets(self) -> int | None:
        names = [n for n in self._names(f"{self.path}/layout") if n.startswith("buckets-")]
        return max((int(n.removeprefix("buckets-")) for n in names), default=None)

    def _keep_buckets(self) -> None:
        if self._kept_buckets() is None:
            self._put_new(f"{self.path}/layout/buckets-{self.buckets}", "")

    # -- versions -----------------------------------------------------------------

    def _versions(self) -> list[int]:
        return sorted(int(n) for n in self._names(f"{self.path}/versions") if n.isdigit())

    def version(self) -> int | None:
        """The newest version."""
        return max(self._versions(), default=None)

    def manifest(self, version: int | None) -> Manifest:
        """That version's manifest; of none an empty one."""
        if version is None:
            return Manifest(-1)
        return Manifest(**json.loads(self._text(f"{self.path}/versions/{version}")))

    def has_batch(self, batch: str) -> bool:
        """Did some version take in this batch?"""
        return self.manifest(self.version()).has(batch)

    def _claim(self, manifest: Manifest) -> None:
        path = f"{self.path}/versions/{manifest.version}"
        if not self._put_new(path, json.dumps(manifest.__dict__)):
            raise Conflict(f"version {manifest.version} of {self.path} is taken")
        if self.version() > manifest.version:  # the number was free because it has expired
            self._delete(path)
            raise Conflict(f"{self.path} is past version {manifest.version}")

    # -- tables -------------------------------------------------------------------

    def bucket_of(self, key: str) -> Column:
        """The bucket of a row, as Spark's own bucketing has it."""
        return F.expr(f"pmod(hash({key}), {self.buckets})")

    def touched(self, rows: DataFrame, key: str = "id") -> list[int]:
        """The buckets that hold the keys of ``rows``: a number for each bucket at most."""
        return sorted(r[0] for r in rows.select(self.bucket_of(key)).distinct().collect())

    def _write(self, rows: DataFrame, name: str, folder: str, placed: bool) -> list[int]:
        """Write rows by bucket and return the buckets that have some."""
        key, schema = self.KEYS[name]
        rows = sc.conform(rows, schema) if name == "state" else rows.select(*schema.names)
        if not placed:
            rows = rows.repartition(self.buckets, key)
        where = f"{self.path}/{name}/{folder}"
        table = f"listsieve_{self._tag}_{name}_{folder}"
        writer = rows.withColumn(BUCKET, self.bucket_of(key)).write.format("parquet").partitionBy(BUCKET)
        writer.bucketBy(self.buckets, key).sortBy(key).option("path", where).saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # the files stay
        return [int(n.partition("=")[2]) for n in self._names(where) if n.startswith(f"{BUCKET}=")]

    def _read(self, name: str, manifest: Manifest, buckets: list[int] | None) -> DataFrame:
        key, schema = self.KEYS[name]
        held = manifest.tables.get(name, {})
        if not held:
            return self.spark.createDataFrame([], schema)
        table = f"listsieve_{self._tag}_{name}_v{manifest.version}"
        if not self.spark.catalog.tableExists(table):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            self.spark.sql(
                f"CREATE TABLE {table} ({columns}, {BUCKET} int) USING parquet PARTITIONED BY ({BUCKET}) "
                f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'"
            )
            places = [
                f"PARTITION ({BUCKET}={b}) LOCATION '{self.path}/{name}/{folder}/{BUCKET}={b}'"
                for folder, own in held.items()
                for b in own
            ]
            self.spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {' '.join(places)}")
        rows = self.spark.table(table)
        if buckets is not None:
            rows = rows.where(F.col(BUCKET).isin(buckets))
        return rows.select(*schema.names)

    # -- state --------------------------------------------------------------------

    def load(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The state at a version, the newest by default; empty before the first one. Rows that
        had gone stale by the version's last merge are left out, wherever they still lie.
        ``buckets`` reads those alone."""
        if version is None:
            version = self.version()
            self._seen = -1 if version is None else version
        manifest = self.manifest(version)
        rows = self._read("state", manifest, buckets)
        return rows if manifest.as_of is None else retain(rows, manifest.as_of, manifest.days)

    def load_crawled(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        if version is None:
            version = self.version()
            self._seen = -1 if version is None else version
        manifest = self.manifest(version)
        rows = self._read("crawled", manifest, buckets)
        return rows if manifest.as_of is None else unexpired(rows, manifest.as_of)

    def save(
        self,
        state: DataFrame | None,
        crawled: DataFrame | None = None,
        batch: str = "",
        placed: bool = False,
        base: int | None = None,
        touched: dict[str, list[int]] | None = None,
        now=None,
        days: int = RETENTION_DAYS,
        profile: str | None = None,
    ) -> int:
        """Write both as the version after ``base`` and return its number; None leaves a table as it is.

        ``base`` is the version that the rows derive from (-1: none yet), by default the one this
        store was last read at. If another writer has committed since, ``Conflict`` is raised and nothing changes.
        A batch some version already took in changes nothing either. ``placed`` says that
        ``state`` came out of a join with the stored state, so its rows already lie by bucket and
        need not be shuffled again. ``touched``: the buckets, by table, that are given and replaced;
        all by default. ``now``, the moment of the merge, is what retention goes by on read.
        """
        current = self.version()
        manifest = self.manifest(current)
        if batch and manifest.has(batch):
            return current
        if base is None:
            base = manifest.version if self._seen is None else self._seen
        if base != manifest.version:
            raise Conflict(f"{self.path} is at version {current}; the rows derive from {base}")
        self._keep_buckets()
        manifest.version += 1
        folder = uuid.uuid4().hex
        for name, rows in (("state", state), ("crawled", crawled)):
            if rows is not None:
                own = (touched or {}).get(name)
                stays = placed and name == "state" and current is not None
                written = self._write(rows, name, folder, stays)
                manifest.place(name, folder, written, range(self.buckets) if own is None else own)
        manifest.take(batch)
        manifest.days = days
        manifest.profile = profile or manifest.profile
        manifest.as_of = manifest.as_of if now is None else self._moment(now)
        try:
            self._claim(manifest)
        except Conflict:
            for name in self.KEYS:
                self._delete(f"{self.path}/{name}/{folder}")
            raise
        self._seen = manifest.version
        return manifest.version

    def _moment(self, now) -> str:
        """As text that means the same moment in every session."""
        if isinstance(now, dt.datetime) and now.tzinfo is not None:
            return now.isoformat()
        told = F.date_format(F.to_utc_timestamp(as_time(now), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        return self.spark.range(1).select(told).first()[0]

    def update(
        self, change: Callable[[int | None], dict], batch: str = "", attempts: int = ATTEMPTS, **options
    ) -> int:
        """Commit what ``change`` makes of a version, on the newest one; done again on a newer one
        where another writer was first. ``change`` takes the version that it is to read and gives
        the arguments of ``save``. A batch some version took in is not merged again.
        """
        for left in reversed(range(attempts)):
            base = self.version()
            if batch and self.manifest(base).has(batch):
                return base
            try:
                return self.save(**change(base), batch=batch, base=-1 if base is None else base, **options)
            except Conflict:
                if not left:
                    raise
        raise ValueError("attempts must be 1 or more")

    def expire(self, keep: int = 2) -> list[int]:
        """Delete all but the newest ``keep`` versions, and buckets that only they hold; returns
        those deleted. Names of batches live on in the newest manifest."""
        versions = self._versions()
        old, kept = versions[:-keep], versions[-keep:]
        held = set().union(*(self.manifest(v).folders() for v in kept))
        for version in old:
            for name, folder, bucket in self.manifest(version).folders() - held:
                self._delete(f"{self.path}/{name}/{folder}/{BUCKET}={bucket}")
                held.add((name, folder, bucket))
            for name in self.KEYS:
                self.spark.sql(f"DROP TABLE IF EXISTS listsieve_{self._tag}_{name}_v{version}")
            self._delete(f"{self.path}/versions/{version}")
        return old


# ---- States kept as one JSON object --------------------------------------------


def _legacy_entry() -> str:
    known = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in sc.STATE.fields)
    return f"struct<{known}, applied: boolean, applied_at: timestamp>"


def load_state(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON object of entries by id, old ones with only an ``applied`` flag included; with
    ``lines``, entries one to a line. A large file is read by many tasks.

    A missing file is an empty state.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], sc.STATE)
    shape = _legacy_entry()
    if lines:
        rows = spark.read.text(path).where(F.trim("value") != "")
        return migrate_legacy(rows.select(F.from_json("value", shape).alias("job")).select("job.*"))
    entries = object_entries(spark, path).select("key", F.from_json("value", shape).alias("job"))
    return migrate_legacy(entries.select("key", "job.*").withColumn("id", F.coalesce("id", "key")))


def migrate_legacy(entries: DataFrame) -> DataFrame:
    """An ``applied`` flag without a status means the status "applied"."""
    old = (F.coalesce("status", F.lit("")) == "") & F.coalesce("applied", F.lit(False))
    migrated = entries.withColumns(
        {
            "status_at": F.when(old, F.col("applied_at")).otherwise(F.col("status_at")),
            "status": F.when(old, F.lit("applied")).otherwise(F.col("status")),
        }
    )
    state = sc.conform(migrated, sc.STATE)
    # The zero time stands for "none" in such files.
    times = [f.name for f in sc.STATE.fields if isinstance(f.dataType, T.TimestampType)]
    return state.withColumns({t: F.when(F.year(t) > 1, F.col(t)) for t in times})


def load_crawled(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of times by URL."""
    if not _exists(spark, path):
        return spark.createDataFrame([], sc.CRAWLED)
    entries = text_entries(spark, path)
    return entries.select(F.col("key").alias("url"), F.col("value").cast("timestamp").alias("crawled_at"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(where))


def save_state(df: DataFrame, path: str, buckets: int | None = None) -> int:
    """Write a state as the next snapshot version under ``path``."""
    return StateStore(df.sparkSession, path, buckets).save(df)
