"""Raw account files: fixed schema, current column names, NULL for missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pdengine import fixed_values as fv

RAW_SCHEMA = T.StructType(
    [T.StructField("ID", T.LongType()), T.StructField("LIMIT_BAL", T.DoubleType())]
    + [T.StructField(c, T.IntegerType()) for c in ("SEX", "EDUCATION", "MARRIAGE", "AGE")]
    + [T.StructField(c, T.IntegerType()) for c in ["PAY_0"] + fv.PAY_COLS[1:]]
    + [T.StructField(c, T.DoubleType()) for c in fv.BILL_COLS + fv.PAY_AMT_COLS]
    + [T.StructField("default payment next month", T.IntegerType())]
)


def normalise_accounts(raw: DataFrame) -> DataFrame:
    """Current names; the file's row number becomes the borrower key."""
    renamed = raw.withColumnsRenamed(fv.RAW_RENAMES)
    doubles = [f.name for f in renamed.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return renamed.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in doubles})


def _csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of CSV files as they stand."""
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in RAW_SCHEMA.fields])
    return spark.read.schema(texts).option("header", True).csv(path)


def read_accounts(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Accounts of raw files; CSV cells that are no numbers become NULL, ``account_rejects`` names them."""
    if file_format == "csv":
        cells = _csv_cells(spark, path)
        return normalise_accounts(cells.select(*[F.trim(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in RAW_SCHEMA.fields]))
    return normalise_accounts(spark.read.schema(RAW_SCHEMA).format(file_format).load(path))


def account_rejects(spark: SparkSession, path: str) -> DataFrame:
    """``(id, column_name, cell, file)`` of every CSV cell that is neither empty nor a number of its column's type."""
    cells = _csv_cells(spark, path).withColumn("_file", F.input_file_name())
    bad = [
        F.when(
            (F.trim(f"`{f.name}`") != "") & F.trim(f"`{f.name}`").try_cast(f.dataType).isNull(),
            F.struct(F.lit(f.name).alias("column_name"), F.col(f"`{f.name}`").alias("cell")),
        )
        for f in RAW_SCHEMA.fields
    ]
    return cells.select(F.col("ID").alias("id"), F.explode(F.array_compact(F.array(*bad))).alias("r"), F.col("_file").alias("file")).select(
        "id", "r.column_name", "r.cell", "file"
    )
