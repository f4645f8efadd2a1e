"""Settings that the stateful jobs need while they start."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    # Keyed state outgrows executor heaps, so it lives in RocksDB.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Expired state goes along with the next data. A job with processing-time state would otherwise never finish under
    # ``availableNow``, as there is always a later time to check.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Start stateful queries in here: they keep the settings, the session gets its own back."""
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
