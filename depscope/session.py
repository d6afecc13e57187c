"""Session settings the operators are designed around."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot join keys and hot output buckets are split at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Sessions of one key are merged per map task before they are shuffled.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.session.timeZone": "UTC",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the settings to a session builder; cluster sizing stays with the caller."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def prepare_streaming(spark: SparkSession) -> None:
    """Give a session that was built elsewhere the settings that streaming operators need."""
    for key, value in SETTINGS.items():
        if ".streaming." in key:
            spark.conf.set(key, value)
