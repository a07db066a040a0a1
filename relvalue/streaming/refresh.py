"""Rebuild and publish the result whenever new snapshots have landed.

The loader drops one small JSON object ``{"snapshot_ts": ..., "root": ..., "sources": [...]}`` into a ready
folder once a set of snapshots is complete; ``sources`` names those that landed, none named means all. The
stream watches that folder and serves every notice of a batch, oldest first.

What a run was built from is kept in a manifest. A notice is built only if a source it reads has another snapshot
than the run before it, or if that run is older than its shortest-lived source may be.
"""

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from relvalue import schemas as S
from relvalue.plans.screener import ScreenerResult, build_screener
from relvalue.sources.pointers import append_pointer, newest_pointer
from relvalue.sources.sinks import publish_run
from relvalue.sources.snapshots import freshness_of, read_versions, versions

Build = Callable[[SparkSession, str, dict[str, str]], ScreenerResult]


def build_from_snapshots(spark: SparkSession, root: str, taken: dict[str, str]) -> ScreenerResult:
    feeds = read_versions(spark, root, taken)
    return build_screener(feeds.listing, feeds.flow, feeds.market)


def is_due(manifest: dict | None, root: str, taken: dict[str, str], now: float) -> bool:
    """Whether the run of ``manifest`` does no longer stand for these snapshots."""
    if manifest is None or (manifest["root"], manifest["snapshots"]) != (root, taken):
        return True
    return now - manifest["built_at"] > min(S.TTL_SECONDS[source] for source in taken)


def refresh(
    spark: SparkSession,
    ready: str,
    target: str,
    checkpoint: str,
    once: bool = True,
    build: Build = build_from_snapshots,
    clock: Callable[[], float] = time.time,
) -> StreamingQuery:
    """Start the stream; with ``once`` it serves what has landed and ends.

    ``checkpoint`` belongs to this stream alone. A notice that can't be served leaves its error object and
    fails the stream, so the batch is served again at the next start; runs already published stay.
    A run's ``sources`` tell the age of each snapshot when it was built.
    """
    manifests = f"{target}/_manifests"

    def serve(batch: DataFrame, batch_id: int) -> None:
        # one row for each set of snapshots that landed since the last batch
        for notice in batch.distinct().orderBy("snapshot_ts", "root").toLocalIterator():
            taken = versions(spark, notice.root, notice.snapshot_ts, notice.sources)
            now = clock()
            if not is_due(newest_pointer(spark, manifests), notice.root, taken, now):
                continue
            folder = f"{target}/snapshot_ts={notice.snapshot_ts}"
            found = spark.createDataFrame(list(taken.items()), "source STRING, snapshot_ts STRING")
            ages = freshness_of(found, F.timestamp_seconds(F.lit(now)))
            if not publish_run(spark, lambda: build(spark, notice.root, taken), folder, ages):  # noqa: B023
                raise RuntimeError(f"no result for {notice.snapshot_ts}; see {folder}")
            append_pointer(spark, manifests, {"root": notice.root, "snapshots": taken, "built_at": now, "folder": folder})

    notices = spark.readStream.schema("snapshot_ts STRING, root STRING, sources ARRAY<STRING>").json(ready)
    writer = notices.writeStream.foreachBatch(serve).option("checkpointLocation", checkpoint)
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime="1 minute").start()
