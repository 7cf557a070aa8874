"""Readers and writers: fact table, status rows, ad-hoc SQL, stored results, CSV export."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from py4j.java_gateway import is_instance_of
from pyspark import SparkContext
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.masking import mask
from .schema import FACT_SCHEMA, with_policy

STATUS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("AgentCode", T.StringType()),
    T.StructField("Status", T.StringType()),
    T.StructField("TotalTalkTime", T.DoubleType()),
])


#: Partition column of a written fact table by the date it is laid out for.
MONTHS = {"leaddate": "lead_month", "bookingdate": "booking_month"}


def load_leads(spark: SparkSession, path: str, fmt: str = "parquet", lead_dates: tuple | None = None,
               booking_dates: tuple | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The fact table with its declared schema (nothing inferred) and masking metadata, both of which
    the schema's fields carry; ``columns`` reads only these (the dates that are bounded among them).

    ``lead_dates`` and ``booking_dates`` = (first, last), either may be None: only rows with
    such a date.  On a table that ``write_leads`` laid out by that date the months outside are
    not read (partition pruning)."""
    schema = FACT_SCHEMA if columns is None else T.StructType([FACT_SCHEMA[c] for c in columns])
    df = spark.read.format(fmt).schema(schema).load(path)
    for date, bounds in (("leaddate", lead_dates), ("bookingdate", booking_dates)):
        for bound, at_least in zip(bounds or (), (True, False)):
            if bound is not None:
                df = df.where(F.col(date) >= F.lit(bound) if at_least else F.col(date) <= F.lit(bound))
                if MONTHS[date] in df.columns:
                    month, first = F.col(MONTHS[date]), F.lit(bound.replace(day=1))
                    df = df.where(month >= first if at_least else month <= first)
    return df.drop(*MONTHS.values())


def jdbc_options(url: str, table: str, partition_column: str, lower, upper, num_partitions: int,
                 fetch_size: int = 10_000, **more: str) -> dict[str, str]:
    """Options of a partitioned read of a SQL store: ``num_partitions`` range queries in parallel.
    Rows outside the bounds, and NULLs, come with the first and last range, so none is lost."""
    if num_partitions < 1:
        raise ValueError("num_partitions must be at least 1")
    return {"url": url, "dbtable": table, "partitionColumn": partition_column, "lowerBound": str(lower),
            "upperBound": str(upper), "numPartitions": str(num_partitions), "fetchsize": str(fetch_size), **more}


def load_leads_jdbc(spark: SparkSession, **options) -> DataFrame:
    """The fact table of a SQL store (``jdbc_options``), cast to the declared schema."""
    df = spark.read.format("jdbc").options(**jdbc_options(**options)).load()
    return with_policy(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FACT_SCHEMA.fields]))


def write_leads(df: DataFrame, path: str, partition_by_month: bool = True,
                max_records_per_file: int = 5_000_000, by: str = "leaddate") -> None:
    """Write the fact table laid out ``by`` one of its dates and partitioned by that month, so
    that ``load_leads`` skips whole directories.

    By booking date only rows with a booking are written: the copy that booking-date windows
    read, beside the full table by lead date.  Rows are range-partitioned on (date, leadid): a
    month - or a single day - holding a third of all rows is still cut into many tasks and
    files, and each file is sorted by date so row-group statistics skip the rest of a window.
    The sort leads with the partition column, so the writer needs no extra sort of its own."""
    month = MONTHS[by]
    w = df if by == "leaddate" else df.where(F.col(by).isNotNull())
    if partition_by_month:
        w = w.withColumn(month, F.trunc(by, "MM"))
    order = ([month] if partition_by_month else []) + [by, "leadid"]
    w = w.repartitionByRange(by, "leadid").sortWithinPartitions(*order)
    writer = w.write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file)
    if partition_by_month:
        writer = writer.partitionBy(month)
    writer.parquet(path)


def status_rows(df: DataFrame) -> DataFrame:
    """Status rows in the status schema, with ``LastUpdatedOn`` for the event time."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in STATUS_SCHEMA.fields],
                     F.col("ts").alias("LastUpdatedOn"))


def load_status(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return status_rows(spark.read.format(fmt).schema(STATUS_SCHEMA).load(path))


_SELECT = re.compile(r"^\s*select\b", re.IGNORECASE)


def adhoc(spark: SparkSession, sql: str, views: dict[str, DataFrame]) -> DataFrame:
    """Run a user's single SELECT over the given views; anything else is refused, also a
    SELECT that names another table, a file path or a table function."""
    text = sql.strip().rstrip(";").strip()
    if not _SELECT.match(text):
        raise ValueError("only a single SELECT statement is accepted")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as e:
        raise ValueError(f"only one SELECT statement is accepted: {e}") from e
    tables, functions = _parts(plan)
    others = tables - {v.lower() for v in views}
    if others:
        raise ValueError(f"only {sorted(views)} may be read, not {sorted(others)}")
    strange = sorted(f for f in functions if f in _OUTWARD or not _built_in(spark, f))
    if strange:
        raise ValueError(f"functions {strange} are not accepted")
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)


#: Functions that leave the data: Java calls, files, the session and other tables.
_OUTWARD = frozenset({"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length",
                      "current_user", "user", "session_user", "current_catalog", "current_database", "current_schema", "version"})


def _built_in(spark: SparkSession, name: str) -> bool:
    """Whether a function comes with Spark (no user-defined or catalog function)."""
    registry = spark._jsparkSession.sessionState().functionRegistry()
    found = registry.lookupFunction(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
    return found.isDefined() and found.get().getSource() == "built-in"


def _parts(plan) -> tuple[set[str], set[str]]:
    """Lower-case names of all tables and functions of a parsed plan, subqueries included.  The parser is
    the session's own: a ``;`` inside a text is no second statement, and two statements do not parse.  This
    reads the plan in this process's JVM; a remote session has none."""
    tables, functions, todo, gateway = set(), set(), [plan], SparkContext._gateway
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            tables.add(node.tableName().lower())
        elif "TableValuedFunction" in kind:
            tables.add(kind)
        elif kind == "UnresolvedFunction":
            functions.add(".".join(_names(node.nameParts())).lower())
        is_plan = is_instance_of(gateway, node, "org.apache.spark.sql.catalyst.plans.QueryPlan")
        for seq in (node.children(), *([node.expressions()] if is_plan else [])):
            todo += [seq.apply(i) for i in range(seq.size())]
        if kind in ("ScalarSubquery", "ListQuery", "Exists"):
            todo.append(node.plan())
        elif kind == "UnresolvedWith":
            tables.add("WITH")
    return tables, functions


def _names(seq) -> list[str]:
    return [seq.apply(i) for i in range(seq.size())]


def query_id(sql: str) -> str:
    """Key of a stored result: first 8 hex digits of MD5 of its SQL text."""
    return hashlib.md5(sql.encode("utf-8")).hexdigest()[:8]


def save_result(df: DataFrame, base: str, sql: str, raw: bool = False) -> str:
    """Store a result below ``base/<query id>``: masked by default, raw only on request."""
    qid = query_id(sql)
    (df if raw else mask(df)).write.mode("overwrite").parquet(f"{base}/{qid}/data")
    return qid


def load_result(spark: SparkSession, base: str, qid: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{qid}/data")


def export_csv(df: DataFrame, path: str, raw: bool = False) -> str:
    """Export for download: CSV with a header, written in parallel part files; masked by
    default, raw only on request."""
    (df if raw else mask(df)).write.mode("overwrite").option("header", True).csv(path)
    return path


def read_export(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)
