"""Export to CSV, JSON and Parquet folders, with filters, estimates and a check."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("csv", "json", "parquet")
# fixed values: bytes per row, advice limits, seconds cap
BYTES_PER_ROW = {"csv": 100, "json": 150, "parquet": 50}
CHUNKED_ABOVE, PARQUET_ABOVE, MAX_SECONDS, ROWS_PER_SECOND = 50_000, 10_000, 300, 10_000
DATE_WORDS = ("time", "date", "anno", "year")
REQUIRED_COLUMNS = ("TIME_PERIOD", "OBS_VALUE")
VALID_SHARE = 0.8
# text formats keep microseconds
TIME_FORMATS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def export_filters(
    df: DataFrame,
    columns: list[str] | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Pick columns, then bound the first date-like column left, then limit.

    Unknown names are ignored (all columns stay if none is known). With a bound, rows
    whose date does not parse are dropped and the column becomes a timestamp. A limit
    takes the first rows in column order.
    """
    known = [c for c in columns or [] if c in df.columns]
    rows = df.select(*known) if known else df
    dates = [c for c in rows.columns if any(w in c.lower() for w in DATE_WORDS)]
    if dates and (start or end):
        name = dates[0]
        dtype = rows.schema[name].dataType
        if not isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            text = F.col(name).cast("string")
            # a bare year, or year and month, is the first day of it
            full = (
                F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01")))
                .when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01")))
                .otherwise(text)
            )
            rows = rows.withColumn(name, full.try_cast("timestamp_ntz"))
            dtype = T.TimestampNTZType()
        if start:
            rows = rows.where(F.col(name) >= F.lit(start).cast(dtype))
        if end:
            rows = rows.where(F.col(name) <= F.lit(end).cast(dtype))
    if limit and limit > 0:
        # maps take part in the order as arrays of their entries
        order = [F.array_sort(F.map_entries(f.name)) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in rows.schema]
        rows = rows.orderBy(*[c.asc_nulls_last() for c in order]).limit(limit)
    return rows


def _nested(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]


def export(
    df: DataFrame, path: str, fmt: str, dataset_id: str | None = None, exported_at: datetime | None = None, chunk_rows: int = 0
) -> None:
    """Write one folder. CSV has a header, and its maps, arrays and structs are JSON text; Parquet is snappy,
    JSON gets a metadata row next to its records. ``chunk_rows`` bounds the rows of a file. Zero rows leave a
    folder that still carries the columns where the format can."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt}; use one of {FORMATS}")
    counted = Observation()
    rows = df.observe(counted, F.count("*").alias("total_records")) if fmt == "json" else df
    if fmt == "csv":
        rows = rows.withColumns({c: F.to_json(c) for c in _nested(df.schema)})
    writer = rows.write.mode("overwrite")
    if chunk_rows:
        writer = writer.option("maxRecordsPerFile", chunk_rows)
    if fmt == "csv":
        writer.options(header=True, **TIME_FORMATS).csv(path)
    elif fmt == "parquet":
        writer.option("compression", "snappy").parquet(path)
    else:
        # NULL fields are written, so that every record has every column
        writer.options(ignoreNullFields=False, **TIME_FORMATS).json(f"{path}/data")
        meta = [(dataset_id, exported_at, counted.get["total_records"], df.columns)]
        df.sparkSession.createDataFrame(
            meta, "dataset_id string, exported_at timestamp, total_records long, columns array<string>"
        ).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def export_chunked(df: DataFrame, path: str, fmt: str, chunk_rows: int | None = None, **meta) -> None:
    """The files of the folder are the chunks: of the size that partitions have after a shuffle
    (``spark.sql.adaptive.advisoryPartitionSizeInBytes``), or of ``chunk_rows`` at most where a caller asks for rows."""
    export(df.hint("rebalance") if chunk_rows is None else df, path, fmt, chunk_rows=chunk_rows or 0, **meta)


def read_export(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    """Read an export back with its known schema."""
    if fmt == "csv":
        nested = _nested(schema)
        flat = T.StructType([T.StructField(f.name, T.StringType() if f.name in nested else f.dataType) for f in schema])
        rows = spark.read.options(header=True, **TIME_FORMATS).schema(flat).csv(path)
        return rows.withColumns({c: F.from_json(c, schema[c].dataType) for c in nested})
    return spark.read.options(**TIME_FORMATS).schema(schema).format(fmt).load(f"{path}/data" if fmt == "json" else path)


def export_estimate(df: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Per dataset: rows, size per format in MB, advice and expected seconds."""
    n = F.col("row_count")
    size = {f"{f}_mb": F.round(n * b / F.lit(1024.0 * 1024.0), 2) for f, b in BYTES_PER_ROW.items()}
    return (
        df.groupBy(key)
        .agg(F.count("*").alias("row_count"))
        .withColumns(
            size
            | {
                "recommended_streaming": n > CHUNKED_ABOVE,
                "optimal_format": F.when(n > PARQUET_ABOVE, "parquet").otherwise("csv"),
                "estimated_seconds": F.least(n / F.lit(float(ROWS_PER_SECOND)), F.lit(float(MAX_SECONDS))),
            }
        )
    )


def validate_export(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Per file: bytes, rows and whether it is valid: it has rows, and a required column.

    A CSV file has the columns of its own first line; a Parquet or JSON file those in which any of its rows has a
    value. The metadata of a JSON export is no data file.
    """
    data = f"{path}/data" if fmt == "json" and _exists(spark, f"{path}/data") else path
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(data).select("path", "length")
    reader = spark.read.option("recursiveFileLookup", True)
    file = F.col("_metadata.file_path").alias("_path")
    if fmt == "csv":
        # the first line of a file is where its first split starts
        lines = reader.text(data).select(file, F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"), "value")
        names = F.transform(F.split("_head", ","), lambda c: F.trim(F.replace(c, F.lit('"'), F.lit(""))))
        counts = lines.groupBy("_path").agg((F.count("*") - 1).alias("_rows"), F.min_by("value", F.struct("b", "n")).alias("_head"))
        counts = counts.select("_path", "_rows", F.arrays_overlap(names, F.array(*map(F.lit, REQUIRED_COLUMNS))).alias("_has"))
    else:
        rows = (reader.option("mergeSchema", True) if fmt == "parquet" else reader).format(fmt).load(data)
        found = [F.count(c) > 0 for c in REQUIRED_COLUMNS if c in rows.columns]
        has = reduce(lambda a, b: a | b, found, F.lit(False))
        counts = rows.groupBy(file).agg(F.count("*").alias("_rows"), has.alias("_has"))
    # the two sources write the scheme of a path differently
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")
    joined = files.join(counts, plain("path") == plain("_path"), "left")
    n = F.greatest(F.coalesce("_rows", F.lit(0)), F.lit(0))
    return joined.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("length").alias("bytes"),
        n.alias("row_count"),
        ((n > 0) & F.coalesce("_has", F.lit(False))).alias("is_valid"),
    )


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def export_is_valid(checked: DataFrame) -> DataFrame:
    """Share of valid files and whether it reaches the limit."""
    share = F.coalesce(F.try_divide(F.count_if("is_valid").cast("double"), F.count("*")), F.lit(0.0))
    return checked.agg(F.count("*").alias("files"), share.alias("valid_share")).withColumn(
        "passed", F.col("valid_share") >= VALID_SHARE
    )
