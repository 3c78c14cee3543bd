"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# A join on (page_id, parent_id) may reuse data that is hash-partitioned by page_id alone,
# so that the one exchange of the shred serves every later window and join.
SETTINGS = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the setting to a session made elsewhere; nothing else of it is touched."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def get_session(master: str | None = None, partitions: int | None = None,
                config: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings of the library and, on top, those given."""
    start = {
        "spark.ui.enabled": "false",
        # A shred compiles more expressions than the default cache of 100 classes holds.
        "spark.sql.codegen.cache.maxEntries": "1000",
        **(config or {}),
    }
    if partitions:
        start["spark.sql.shuffle.partitions"] = str(partitions)
    builder = SparkSession.builder.appName("domgrove")
    for key, value in start.items():
        builder = builder.config(key, value)
    if master:
        builder = builder.master(master)
    return configure(builder.getOrCreate())
