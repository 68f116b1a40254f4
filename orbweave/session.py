"""Session helper and table loader."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def get_session(cores: int | str = "*", app: str = "orbweave", **conf: str) -> SparkSession:
    """A local session with the settings that tests, bench and oracle comparison rely on.

    On a cluster, build the session as the cluster asks and skip this helper; no operator
    depends on a setting made here.
    """
    os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")
    b = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where the driver found it, if it was not installed or shipped otherwise.

    Harmless on a cluster, where the package comes with ``--py-files`` or the image.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH", ""), root]))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
