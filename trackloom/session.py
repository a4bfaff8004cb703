"""A session with the settings that the library is tested under. Any other session will do as well."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cpus: int | str = "*", memory: str = "12g", **conf: str) -> SparkSession:
    """A local session; on a cluster, submit with its own settings and ``spark.checkpoint.dir``."""
    cores = cpus if isinstance(cpus, int) else 8
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("trackloom")
        .config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.files.maxPartitionBytes", "32m")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
