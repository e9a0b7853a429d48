"""Readers and writers of the support desk's files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions import text

# The raw files and their columns.
FILES = {
    "tickets": "ticket_id created_at first_response_at resolved_at status channel customer_id order_id product_sku category priority assigned_team agent_id transfers csat_score refund_amount_inr refund_reason_code replacement_issued customer_message agent_notes source_system".split(),
    "agents": "agent_id name site team shift tier from_date to_date".split(),
    "orders": "order_id customer_id sku order_date channel qty order_value_inr lot_code".split(),
    "customers": "customer_id name city state signup_date care_plus".split(),
    "products": "sku product_name family launch_date unit_cost_inr retail_price_inr warranty_months".split(),
}
STAMP = "yyyy-MM-dd HH:mm"


def read_raw(spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(FILES)) -> dict[str, DataFrame]:
    """All files as strings; blanks stay empty strings and a value such as NA stays what it is.

    Files are looked up in whatever store the folder lives in; if any is
    missing, the error names all that are.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    missing = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.csv")
        if not path.getFileSystem(conf).exists(path):
            missing.append(f"{name}.csv")
    if missing:
        raise FileNotFoundError(f"missing in {folder}: {', '.join(missing)}")
    return {name: read_csv(spark, f"{folder}/{name}.csv", FILES[name]) for name in names}


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header as strings, matched by position to ``columns``."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    frame = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\0").option("emptyValue", "").csv(path)
    return frame.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def to_number(c: Column) -> Column:
    return blank_to_null(c).try_cast("double")


def to_whole(c: Column, default: int | None = None) -> Column:
    n = to_number(c).cast("int")
    return n if default is None else F.coalesce(n, F.lit(default))


def to_stamp(c: Column, pattern: str = STAMP) -> Column:
    """Wall-clock time without zone; what does not parse is null."""
    return F.coalesce(F.try_to_timestamp(c, F.lit(pattern)), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))).cast("timestamp_ntz")


def to_date(c: Column) -> Column:
    return to_stamp(c).cast("date")


def read_records(spark: SparkSession, path: str, schema: str, field: str | None = None) -> DataFrame:
    """JSON that is a list of records, or an object whose ``field`` is one."""
    if field is None:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    whole = spark.read.schema(f"{field} array<struct<{schema}>>").option("multiLine", True).json(path)
    return whole.select(F.explode(field).alias("r")).select("r.*")


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    frame = spark.read.parquet(path)
    return frame.select(*columns) if columns else frame


def read_jdbc(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A relational scan; ``partition`` (column, lower, upper, n) reads it in parallel."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition:
        column, lower, upper, n = partition
        return reader.option("dbtable", f"({query}) q").option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", n).load()
    return reader.option("query", query).load()


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; ``single`` is for small reports only."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def replace_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Truncate and load."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def markdown(title: str, sections: list[tuple[str, DataFrame]], limit: int = 50, money: tuple[str, ...] = (), shares: tuple[str, ...] = ()) -> str:
    """A report of small aggregates, a table each. A table of more than ``limit`` rows says how many are not shown.

    Columns named in ``money`` are written as rupees, those in ``shares`` as percentages.
    """
    lines = [f"# {title}"]
    for name, df in sections:
        own = [text.rupees(F.col(c)).alias(c) if c in money else text.percent(F.col(c)).alias(c) if c in shares else F.col(f"`{c}`") for c in df.columns]
        rows = df.select(*own).limit(limit + 1).collect()
        lines += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        lines += ["| " + " | ".join(_cell(v) for v in row) + " |" for row in rows[:limit]]
        if len(rows) > limit:
            lines += ["", f"{df.count() - limit:,} more rows are not shown."]
    return "\n".join(lines) + "\n"


def _cell(value: object) -> str:
    if value is None:
        return ""
    return f"{value:,.2f}" if isinstance(value, float) else str(value).replace("|", "\\|")


def board_json(sections: dict[str, DataFrame], limit: int = 500) -> str:
    """Small aggregates as one JSON document; a section of more than ``limit`` rows is an error, since a document that lacks rows would not show it."""
    out = {}
    for name, df in sections.items():
        rows = df.limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"section {name} has more than {limit} rows")
        out[name] = [r.asDict(recursive=True) for r in rows]
    return json.dumps(out, default=str, sort_keys=True)
