"""Keyed state: first copies across micro-batches, and counts that a listener takes along."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from smelter.session import configured

#: Name under which a stream reports its broken rules.
BROKEN = "broken_rules"

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


def keep_state_on_disk(spark: SparkSession) -> None:
    """Let streams that start from now on keep their state in RocksDB, unless the session names a store.

    State then lies on the executors' disks and in the checkpoint, not in their memory. A batch commits
    the keys it changed; whole snapshots are taken in the background.
    """
    if _CHANGELOG not in spark.conf.getAll:
        spark.conf.set(_CHANGELOG, "true")
    if spark.conf.get(_PROVIDER, "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKS)


@contextmanager
def state_by_cores(spark: SparkSession) -> Iterator[None]:
    """Streams that are started here cut new state by the cores there are, not by the shuffle partitions.

    Each part of the state is opened, committed and logged with every micro-batch, whatever came in, so
    parts that grow in number with the data would cost the square of it. State lies on disk: its parts
    may grow. A stream that has state keeps its parts.
    """
    key = "spark.sql.shuffle.partitions"
    parts = min(int(spark.conf.get(key)), spark.sparkContext.defaultParallelism)
    with configured(spark, {key: str(parts)}):
        yield


def first_copies(
    stream: DataFrame, keys: Sequence[str], order_by: Sequence[str], at: str, wait: str = "1 day"
) -> DataFrame:
    """Rows of a stream that come before all earlier ones of their key, by ``order_by``.

    A copy that comes no earlier in the order than one seen before goes no further; one
    that comes earlier goes on, and the sink replaces what it has. ``at`` is when a row came
    in: state of a key is kept for the time slice of that length, and dropped once the slice is
    over by ``wait``. A copy in a later slice goes on, too, so the sink has to compare.

    Copies are combined before the shuffle. For a sink in update mode.
    """
    columns = stream.columns
    # In a lambda, which is not compiled: as a constant in the code it would have it compiled anew for each batch.
    batch = F.transform(F.array(F.col(at)), lambda _: F.current_timestamp())[0]
    now = stream.withWatermark(at, wait).withColumn("_batch", batch)
    best = now.groupBy(F.window(at, wait).alias("_slice"), *[F.col(key).alias(f"_key_{i}") for i, key in enumerate(keys)]).agg(
        F.min_by(F.struct(*columns, "_batch"), F.struct(*order_by)).alias("_first"),
        F.max("_batch").alias("_last"),
    )
    # A key is reported whenever a copy came in; its first row is news only if it came with this batch.
    return best.filter(F.col("_first._batch") == F.col("_last")).select(*[f"_first.{c}" for c in columns])


class BrokenRules(StreamingQueryListener):
    """Rows per broken rule over all micro-batches of the streams of a session.

    The counts are taken where the rows are parsed and come with the progress of each batch,
    so nothing is read again for them.
    """

    def __init__(self):
        self.rows: Counter[str] = Counter()
        self.batches: list[dict[str, int]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(BROKEN)
        if seen is not None:
            counts = {rule: n for rule, n in seen.asDict().items() if n}
            self.batches.append(counts)
            self.rows.update(counts)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
