"""Session defaults for standalone runs; on a cluster the submitted configuration wins."""

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site capture costs several gateway calls per column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Documents are up to a few MB each: Arrow batches are bounded by bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


def local_session(cores="*", app="parapet", **extra):
    """A local session for tests and benchmarks."""
    conf = {
        **DEFAULTS,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.shuffle.partitions": "8",
        **({"spark.parapet.scanTasks": cores} if str(cores).isdigit() else {}),
        **extra,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark, name):
    """Folder for a stream's checkpoint, below the shared spark.checkpoint.dir, which must be set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared.rstrip('/')}/{name}"
