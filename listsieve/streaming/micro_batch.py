"""The scheduled run as a stream: every trigger takes in what has landed since."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from concurrent.futures import Future

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from listsieve.functions import lexicon as lx
from listsieve.plans.run import Run, run_once, start_up
from listsieve.profile import Profile
from listsieve.sources.raw import read_raw_stream
from listsieve.sources.state_store import StateStore

INTERVAL = "6 hours"
KEEP_VERSIONS = 10


def start(
    landing: DataFrame,
    store: StateStore,
    profile: Profile,
    checkpoint: str,
    read: Callable[[DataFrame], DataFrame] = lambda df: df,
    now: Callable[[DataFrame, int], object] | None = None,
    on_run: Callable[[Run, int], None] | None = None,
    interval: str | None = INTERVAL,
    name: str = "triage",
    keep_versions: int | None = KEEP_VERSIONS,
    **options,
) -> StreamingQuery:
    """Evaluate and merge each micro-batch of ``landing``, a streaming DataFrame.

    ``read`` turns a batch of landed rows into ads. ``interval=None`` takes in
    all that is there and stops. Each batch becomes one state version carrying
    the batch's name; a batch that is replayed after a failure finds its version
    and changes nothing. The name holds the stream's own id, which lasts as long as
    its checkpoint, so several streams may feed one store, at the same time too: who commits
    second merges again. Of a stream the store keeps the last batch's number alone.

    Before the first trigger the state is purged if the profile has changed since. After each
    one all but the newest ``keep_versions`` versions are deleted (None: no version is); give it
    more than others may have written while someone still reads an old one.
    """
    start_up(store, profile, options.get("lexicon", lx.DEFAULT_LEXICON))
    stream: Future[str] = Future()

    def take_in(rows: DataFrame, batch_id: int) -> None:
        batch = f"{name}-{stream.result()}-{batch_id}"
        if store.has_batch(batch):
            return
        moment = dt.datetime.now(dt.timezone.utc) if now is None else now(rows, batch_id)
        run = run_once(store, read(rows), profile, moment, batch=batch, **options)
        if keep_versions is not None:
            store.expire(keep_versions)
        if on_run is not None:
            on_run(run, batch_id)

    writer = landing.writeStream.queryName(name).option("checkpointLocation", checkpoint)
    once = {"availableNow": True} if interval is None else {"processingTime": interval}
    query = writer.foreachBatch(take_in).trigger(**once).start()
    stream.set_result(query.id)
    return query


def start_from_files(
    spark: SparkSession, landing: str, store: StateStore, profile: Profile, checkpoint: str, **options
) -> StreamingQuery:
    """The same, over raw response files landing in a folder."""
    return start(read_raw_stream(spark, landing), store, profile, checkpoint, **options)


def forget_last_commit(spark: SparkSession, checkpoint: str) -> int | None:
    """Take the last commit off a stopped stream's checkpoint, so that its batch comes again when
    the stream starts; returns the batch's number. For trying out what a replay does."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    names = [f.getPath() for f in fs.listStatus(folder)]
    last = max((p for p in names if p.getName().isdigit()), key=lambda p: int(p.getName()), default=None)
    if last is None:
        return None
    fs.delete(last, False)
    return int(last.getName())
