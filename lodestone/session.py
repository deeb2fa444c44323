"""A SparkSession with the engine's defaults; anything set already stays."""

import tempfile
import uuid

from pyspark.sql import SparkSession

from lodestone.errors import ConfigError

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "lodestone", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def workspace(spark: SparkSession, name: str) -> str:
    """A new path for tables of a job, in the folder that ``spark.checkpoint.dir`` says all executors share.

    Only a local master gets a temporary folder where that is unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ConfigError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return f"{base.rstrip('/')}/lodestone-{name}-{uuid.uuid4().hex}"
