"""Sources and sinks: what is written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import clean
from furrow.session import scratch_path
from furrow.sources import documents, files
from furrow.workload.registry import query, table


@query("""WITH e AS (SELECT event_id, event_type, props, CAST(user_id AS VARCHAR) AS u FROM events)
SELECT event_id, true AS is_bad, NULL::INTEGER AS pos, NULL::VARCHAR AS cell_type, NULL::VARCHAR AS source
FROM e WHERE event_type = 'error'
UNION ALL SELECT event_id, false, 0, event_type, props FROM e WHERE event_type <> 'error'
UNION ALL SELECT event_id, false, 1, 'note', u || u FROM e WHERE event_type <> 'error'""")
def json_unwrap(spark, sf_dir):
    return _unwrapped(spark, sf_dir)


@query("SELECT count(*) AS n_bad FROM events WHERE event_type = 'error'")
def json_bad_documents(spark, sf_dir):
    return documents.bad_documents(_unwrapped(spark, sf_dir))


def _unwrapped(spark, sf_dir):
    user = F.col("user_id").cast("string")
    cells = F.array(
        F.struct(F.col("event_type").alias("cell_type"), F.array("props").alias("source")),
        F.struct(F.lit("note").alias("cell_type"), F.array(user, user).alias("source")),
    )
    inner = F.to_json(F.struct(cells.alias("cells")))
    # Error events hold a document that breaks off.
    text = F.when(F.col("event_type") == "error", F.left(inner, F.length(inner) - 3)).otherwise(inner)
    pieces = F.array(F.left(text, F.lit(25)), F.substr(text, F.lit(26)))
    outer = F.to_json(F.struct(F.array(F.struct(pieces.alias("source"))).alias("cells")))
    return documents.unwrap_json(
        table(spark, sf_dir, "events").select("event_id", outer.alias("document")), "document", ["event_id"]
    )


@query("""SELECT c_custkey::DOUBLE AS c_custkey, c_name || ' "' || c_custkey || '", kept' AS c_name, c_acctbal,
                 nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer""")
def csv_round_trip(spark, sf_dir):
    segment = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    name = F.concat("c_name", F.lit(' "'), "c_custkey", F.lit('", kept'))
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", name.alias("c_name"), "c_acctbal", segment.alias("c_mktsegment")
    )
    path = scratch_path(spark, "csv-round-trip")
    files.write_csv(customers, path)
    return clean.to_numeric(files.read_csv(spark, path, customers.columns), ["c_custkey", "c_acctbal"])


@query("""SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment, false AS is_rejected, NULL::INTEGER AS n_cells FROM customer WHERE c_custkey % 10 > 1
          UNION ALL SELECT NULL, NULL, NULL, true, CASE c_custkey % 10 WHEN 0 THEN 4 ELSE 2 END FROM customer WHERE c_custkey % 10 <= 1""")
def csv_by_header(spark, sf_dir):
    """Two folders of files with their columns in different order; a tenth of the lines has a cell more, a tenth one less."""
    path = scratch_path(spark, "csv-by-header")
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), F.concat(F.lit('"'), "c_name", F.lit('"')).alias("c_name"), "c_mktsegment")
    last = F.col("c_custkey").cast("long") % 10
    for part, order in enumerate((["c_custkey", "c_name", "c_mktsegment"], ["c_mktsegment", "c_custkey", "c_name"])):
        line = F.when(last == 0, F.concat_ws(",", *order, F.lit("extra"))).when(last == 1, F.concat_ws(",", *order[:2])).otherwise(F.concat_ws(",", *order))
        # A table of one column, whose name is the header of each file.
        lines = cells.where(F.col("c_custkey").cast("long") % 2 == part).select(line.alias(",".join(f" {c} " for c in order)))
        lines.write.option("header", True).option("quote", "").option("sep", "\x01").csv(f"{path}/{part}")
    rows, rejected = files.read_csv_by_header(spark, f"{path}/*", ["c_custkey", "c_name", "c_mktsegment"])
    none = [F.lit(None).cast("string").alias(c) for c in ("c_custkey", "c_name", "c_mktsegment")]
    return rows.select("*", F.lit(False).alias("is_rejected"), F.lit(None).cast("int").alias("n_cells")).unionByName(
        rejected.select(*none, F.lit(True).alias("is_rejected"), "n_cells")
    )


@query("""SELECT c_custkey AS id, c_name AS name, c_acctbal AS amount FROM customer
          UNION ALL SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
          UNION ALL SELECT p_partkey, p_name, p_retailprice FROM part""")
def table_bundle(spark, sf_dir):
    """Three tables written as one bundle; the content that comes back."""
    columns = {
        "customer": ("c_custkey", "c_name", "c_acctbal"),
        "orders": ("o_orderkey", "o_orderpriority", "o_totalprice"),
        "part": ("p_partkey", "p_name", "p_retailprice"),
    }
    base = scratch_path(spark, "bundle")
    files.write_tables({name: table(spark, sf_dir, name) for name in columns}, base)
    back = files.read_tables(spark, base, list(columns))
    customers, orders, parts = (back[name].select(*c).toDF("id", "name", "amount") for name, c in columns.items())
    return customers.unionByName(orders).unionByName(parts)


@query("""SELECT CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS type, count(*) AS n_messages,
                 CAST(sum(length(text)) AS BIGINT) AS n_chars, true AS is_stamped FROM conversations GROUP BY 1""")
def append_log(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    path = scratch_path(spark, "log")
    for kind, rows in (("user", turns.where("role = 'user'")), ("assistant", turns.where("role <> 'user'"))):
        files.append_log(rows.select(F.lit(kind).alias("type"), F.col("text").alias("message")), path)
    return files.read_log(spark, path).groupBy("type").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.sum(F.length("message")).alias("n_chars"),
        F.bool_and(F.col("timestamp").isNotNull()).alias("is_stamped"),
    )


@query("""SELECT CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS type, count(*) AS n_messages,
                 CAST(sum(length(text)) AS BIGINT) AS n_chars, true AS few_files FROM conversations GROUP BY 1""")
def event_log(spark, sf_dir):
    """Two batches that overlap, one of them sent twice, and the log compacted: every event once, one file per day."""
    turns = table(spark, sf_dir, "conversations").select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 5).cast("int")).alias("day"), "conv_id", "turn",
        F.when(F.col("role") == "user", "user").otherwise("assistant").alias("type"), F.col("text").alias("message"),
    )
    path = scratch_path(spark, "event-log")
    key = ["conv_id", "turn"]
    first, second = turns.where("conv_id % 3 <> 0"), turns.where("conv_id % 3 <> 1")
    for batch in (first, second, first):
        files.append_events(batch, path, key)
    files.compact_events(spark, path, turns.schema, key)
    log = files.read_events(spark, path, turns.schema)
    per_day = log.groupBy("day").agg(F.count_distinct(F.col("_metadata.file_path")).alias("files"), F.count(F.lit(1)).alias("n"))
    few = per_day.agg(F.coalesce(F.bool_and(F.col("files") <= F.ceil(F.col("n") / files.ROWS_PER_FILE)), F.lit(True))).scalar()
    return log.groupBy("type").agg(
        F.count(F.lit(1)).alias("n_messages"), F.sum(F.length("message")).alias("n_chars")
    ).withColumn("few_files", few)
