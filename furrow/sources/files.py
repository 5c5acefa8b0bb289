"""CSV in and out, table bundles, append-only logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.functions.values import WHITE_SPACE
from furrow.operators.clean import blank_to_null, trim_headers
from furrow.session import shared_dir

# Columns that give back the order of rows in a set of files.
FILE_ORDER = ("file_path", "file_block", "file_row")

LOG_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])


def read_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    with_order: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header, every column as text, missing cells as NULL.

    ``columns`` names the columns by position, so Spark need not look at the files for them; where files may differ in
    the order of their columns, or lines in their number of cells, use :func:`read_csv_by_header`.
    ``with_order`` adds :data:`FILE_ORDER`. ``multi_line`` allows line ends inside quotes; such
    files cannot be split among tasks.
    """
    reader = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
    )
    if columns:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        reader = reader.schema(schema).option("enforceSchema", True)
    raw = reader.csv(path)
    if not with_order:
        return blank_to_null(trim_headers(raw))
    # Within one block of one file the rows arrive in order, so a growing id keeps it.
    ordered = raw.select(
        "*",
        F.col("_metadata.file_path").alias(FILE_ORDER[0]),
        F.col("_metadata.file_block_start").alias(FILE_ORDER[1]),
        F.monotonically_increasing_id().alias(FILE_ORDER[2]),
    )
    return blank_to_null(trim_headers(ordered))


#: A cell of a line: in quotes, which are doubled inside, or up to the next comma.
_CELL = r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'


def _cells(line: Column) -> Column:
    """The cells of a CSV line, without quotes."""
    def bare(cell: Column) -> Column:
        return F.when(cell.startswith('"'), F.replace(F.substr(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))).otherwise(cell)

    return F.transform(F.regexp_extract_all(line, F.lit(_CELL), 1), bare)


def read_csv_by_header(spark: SparkSession, path: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The columns named, found by each file's own header, and the lines that do not fit.

    Files of one folder may have their columns in different order, and further ones, which are not read. Cells come out as by
    :func:`read_csv`: text, trimmed header names, missing ones NULL. The second table has (file, line, n_cells, n_header, text), one row
    per line with more or fewer cells than its header, and for files whose header lacks a column that header, with the
    columns it lacks in ``missing``; the lines of such a file are in neither table. Lines are numbered from 1, blank ones
    included, which are in neither table. Line ends inside quotes are not supported here.
    """
    place = {"__file": "_metadata.file_path", "__block": "_metadata.file_block_start"}
    lines = spark.read.text(path).select(
        F.regexp_replace("value", "^\ufeff", "").alias("__text"), *[F.col(c).alias(a) for a, c in place.items()], F.monotonically_increasing_id().alias("__id")
    )
    # One row per block of a file; lines within a block have consecutive numbers.
    blocks = lines.groupBy("__file", "__block").agg(
        F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"), F.min_by("__text", "__id").alias("__top")
    )
    of_file = Window.partitionBy("__file").orderBy("__block")
    header = _cells(F.first("__top").over(of_file))
    blocks = blocks.select(
        "__file", "__block", "__first", F.coalesce(F.sum("__n").over(of_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.transform(header, lambda c: F.btrim(c, F.lit(WHITE_SPACE))).alias("__header"),
    )
    found = lines.join(blocks, ["__file", "__block"]).select(
        "*", (F.col("__id") - F.col("__first") + F.col("__before") + 1).alias("__line"), _cells(F.col("__text")).alias("__cells"),
        F.array_except(F.lit(list(columns)), "__header").alias("__missing"),
    )
    is_header, is_whole = F.col("__line") == 1, F.size("__missing") == 0
    fits = F.size("__cells") == F.size("__header")
    body = found.where(~is_header & is_whole & (F.trim("__text") != ""))
    rows = body.where(fits).select(*[F.element_at("__cells", F.array_position("__header", c).cast("int")).alias(c) for c in columns])
    rejected = found.where(F.when(is_header, ~is_whole).otherwise(is_whole & ~fits & (F.trim("__text") != ""))).select(
        F.col("__file").alias("file"), F.col("__line").alias("line"), F.size("__cells").alias("n_cells"), F.size("__header").alias("n_header"),
        F.col("__text").alias("text"), F.when(is_header, F.col("__missing")).alias("missing"),
    )
    return blank_to_null(rows), rejected


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; missing cells are empty, text keeps its white space."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_tables(tables: Mapping[str, DataFrame], base: str, format: str = "parquet", mode: str = "overwrite") -> None:
    """Each table in a folder of its own below one base path."""
    for name, df in tables.items():
        path = f"{base.rstrip('/')}/{name}"
        if format == "csv":
            write_csv(df, path, mode)
        else:
            df.write.mode(mode).format(format).save(path)


def read_tables(spark: SparkSession, base: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{base.rstrip('/')}/{name}") for name in names}


def log_records(messages: DataFrame, kind: str = "type", message: str = "message") -> DataFrame:
    """Messages stamped with the time of the job."""
    return messages.select(
        F.col(kind).alias("type"), F.col(message).alias("message"), F.current_timestamp().alias("timestamp")
    )


def append_log(messages: DataFrame, path: str, kind: str = "type", message: str = "message") -> None:
    """Add messages to an append-only parquet log."""
    log_records(messages, kind, message).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(path)


#: Rows of a file of the event log once it has been compacted.
ROWS_PER_FILE = 1_000_000


def _log_schema(events: DataFrame, day: str) -> T.StructType:
    return T.StructType([f for f in events.schema.fields if f.name != day] + [T.StructField(day, T.DateType())])


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The log at a path; empty where none has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _dealt(rows: DataFrame, day: str, key: Sequence[str], rows_per_file: int) -> DataFrame:
    """Each day dealt by a hash of the key into as many pieces as its rows need; a piece lies in one task, so it makes one file."""
    sizes = rows.groupBy(day).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("__pieces")).withColumnRenamed(day, "__day")
    dealt = rows.join(sizes, F.col(day).eqNullSafe(F.col("__day"))).select(
        *rows.columns, F.pmod(F.xxhash64(*key), F.col("__pieces")).alias("__piece")
    )
    return dealt.repartition(day, "__piece").drop("__piece")


def append_events(
    events: DataFrame, path: str, key: Sequence[str], day: str = "day", rows_per_file: int = ROWS_PER_FILE
) -> None:
    """Add the events that a log, partitioned by a date column, does not hold yet.

    Events with equal ``key`` and day are one event: of several in a batch one is kept (the least of all its columns), and one
    that the log holds stays as it is. So a batch that is sent again, whole or in part, or whose job was run anew after a
    loss, changes nothing. Only the days of the batch are read from the log. Two jobs must not append at the same time.
    """
    spark = events.sparkSession
    shared_dir(spark)
    events = events.withColumn(day, F.col(day).cast("date"))
    others = [c for c in events.columns if c not in (day, *key)]
    least = F.min(F.struct(*[F.col(c) for c in others])) if others else F.lit(None)
    one = events.groupBy(day, *key).agg(least.alias("__least")).select(day, *key, *[F.col("__least")[c].alias(c) for c in others])
    fresh = one.select(*events.columns).checkpoint()
    log = _stored(spark, path, _log_schema(events, day)).select(*[F.col(c).alias(f"__log_{c}") for c in (day, *key)])
    # Days are folders: only those of the batch are listed and read.
    known = log.join(fresh.select(day).distinct(), F.col(f"__log_{day}").eqNullSafe(F.col(day)), "left_semi")
    match = F.lit(True)
    for c in (day, *key):
        match = match & F.col(c).eqNullSafe(F.col(f"__log_{c}"))
    # Written to the shared folder first: the log must not change under the query that reads it.
    fresh = fresh.join(known, match, "left_anti").checkpoint()
    _dealt(fresh, day, key, rows_per_file).write.mode("append").partitionBy(day).parquet(path)


def read_events(spark: SparkSession, path: str, schema: T.StructType, day: str = "day") -> DataFrame:
    """The events of a log; ``schema`` names its columns, the day last or not at all."""
    fields = [f for f in schema.fields if f.name != day] + [T.StructField(day, T.DateType())]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def compact_events(
    spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str], day: str = "day", rows_per_file: int = ROWS_PER_FILE
) -> None:
    """Rewrite the days of a log whose files are more than their rows need; no event is added or lost.

    A day then has at most rows / ``rows_per_file`` files, rounded up. Its rows are complete in the shared folder before they
    take the place of the old ones. No job may append at the same time.
    """
    shared_dir(spark)
    log = read_events(spark, path, schema, day)
    crowded = log.groupBy(day).agg(
        F.count(F.lit(1)).alias("__rows"), F.count_distinct(F.col("_metadata.file_path")).alias("__files")
    ).where(F.col("__files") > F.ceil(F.col("__rows") / rows_per_file)).withColumnRenamed(day, "__day")
    rows = log.join(crowded, F.col(day).eqNullSafe(F.col("__day")), "left_semi").checkpoint()
    _dealt(rows, day, key, rows_per_file).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
