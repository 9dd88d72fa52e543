"""Session settings the operators are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution sizes shuffles and joins from measured bytes.  Outside of joins it merges
#: partitions but does not split them, so a large job starts with many: see :func:`session`.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


#: Bytes of input per shuffle partition that a job starts with.
PARTITION_BYTES = 128 << 20


def initial_partitions(input_bytes: int) -> int:
    """Shuffle partitions for so much input; adaptive execution merges what turns out small."""
    return max(200, -(-input_bytes // PARTITION_BYTES))


def session(
    app: str = "spillway",
    master: str | None = None,
    settings: dict[str, str] | None = None,
    input_bytes: int | None = None,
) -> SparkSession:
    """A session with :data:`RECOMMENDED` and then ``settings``.  ``input_bytes``, the size of the
    largest input, sets how many partitions a shuffle starts with."""
    settings = dict(settings or {})
    if input_bytes is not None:
        number = str(initial_partitions(input_bytes))
        settings.setdefault("spark.sql.adaptive.coalescePartitions.initialPartitionNum", number)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**RECOMMENDED, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
