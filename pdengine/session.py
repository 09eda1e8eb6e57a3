"""Session defaults used by the bench and the tests."""

from pyspark.sql import SparkSession


def local_session(cores: int = 8, app_name: str = "pdengine") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Test tables are a few megabytes: let small files and partitions use all cores.
        .config("spark.sql.files.openCostInBytes", "65536")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "65536")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
