"""Table scans with projection and filter, and the row snapshot sink."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from urllib.parse import parse_qsl

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# What a filter of a query string may say: ``column=[not.]operator.value``.
COMPARISONS = {
    "eq": Column.__eq__,
    "neq": Column.__ne__,
    "lt": Column.__lt__,
    "lte": Column.__le__,
    "gt": Column.__gt__,
    "gte": Column.__ge__,
}
IS_VALUES = {"null": None, "true": True, "false": False}
NULLS = {"nullsfirst": "nulls_first", "nullslast": "nulls_last"}


def scan(
    spark: SparkSession,
    path: str | None,
    columns: Sequence[str] = ("*",),
    where: str | Column | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Projected and filtered scan; both reach the parquet reader.

    Without a path the source is not configured and the scan is empty. A bad path raises.
    """
    if path is None:
        return spark.createDataFrame([], schema or T.StructType())
    table = spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    if where is not None:
        table = table.where(where)
    return table.selectExpr(*columns)


def typed(value: str, kind: T.DataType) -> Column:
    """A filter's value as a literal of the column's type, so that the filter can be pushed down."""
    try:
        if isinstance(kind, T.BooleanType):
            return F.lit({"true": True, "false": False}[value])
        if isinstance(kind, T.IntegralType):
            return F.lit(int(value)).cast(kind)
        if isinstance(kind, (T.FractionalType, T.DecimalType)):
            float(value)
        elif isinstance(kind, T.DateType):
            return F.lit(date.fromisoformat(value))
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.lit(datetime.fromisoformat(value)).cast(kind)
        return F.lit(value).cast(kind)
    except (KeyError, ValueError):
        raise ValueError(f"{value!r} is no {kind.simpleString()}") from None


def listed(text: str) -> list[str]:
    """Values of ``(a,b,"c,d")``; double quotes keep commas."""
    if not (text.startswith("(") and text.endswith(")")):
        raise ValueError(f"not a list in brackets: {text!r}")
    values, quoted = [""], False
    for sign in text[1:-1]:
        if sign == '"':
            quoted = not quoted
        elif sign == "," and not quoted:
            values.append("")
        else:
            values[-1] += sign
    return values


def condition(column: str, kind: T.DataType, test: str) -> Column:
    operator, _, value = test.partition(".")
    if operator == "not":
        return ~condition(column, kind, value)
    if operator in COMPARISONS:
        return COMPARISONS[operator](F.col(column), typed(value, kind))
    if operator == "in":
        return F.col(column).isin(*(typed(v, kind) for v in listed(value)))
    if operator == "is" and value in IS_VALUES:
        return F.col(column).eqNullSafe(F.lit(IS_VALUES[value]))
    if operator in ("like", "ilike"):
        return getattr(F.col(column), operator)(value.replace("*", "%"))
    raise ValueError(f"unknown filter {column}={test}")


def query_table(
    spark: SparkSession,
    path: str | None,
    query: str = "select=*",
    schema: T.StructType | None = None,
) -> DataFrame:
    """Scan by a query string: ``select=a,shown:b&c=op.value&order=a.desc.nullslast&limit=10``.

    ``select`` names the columns, with another name before a colon, all of them by default. Every
    other parameter filters: ``eq neq lt lte gt gte in like ilike is``, each after ``not.`` the
    other way; several must all hold. ``order`` takes ``asc`` or ``desc``, missing values last
    in ascending and first in descending order unless said. ``limit`` and ``offset`` count rows.
    An unknown column, filter or value raises. Columns and filters reach the reader.
    """
    table = scan(spark, path, schema=schema)
    if path is None and schema is None:
        return table
    kinds = {f.name: f.dataType for f in table.schema.fields}

    def known(name: str) -> str:
        if name not in kinds:
            raise ValueError(f"unknown column {name!r}")
        return name

    chosen, order, counts = [F.col(f"`{name}`") for name in kinds], [], {}
    for name, value in parse_qsl(query, keep_blank_values=True, strict_parsing=bool(query)):
        if name == "select":
            if value != "*":
                parts = [part.strip().rpartition(":") for part in value.split(",")]
                chosen = [F.col(f"`{known(column)}`").alias(shown or column) for shown, _, column in parts]
        elif name == "order":
            for part in value.split(","):
                column, *words = part.split(".")
                down = "desc" in words
                place = next((NULLS[w] for w in words if w in NULLS), "nulls_first" if down else "nulls_last")
                if set(words) - {"asc", "desc", *NULLS}:
                    raise ValueError(f"unknown order {part!r}")
                order.append(getattr(F.col(f"`{known(column)}`"), f"{'desc' if down else 'asc'}_{place}")())
        elif name in ("limit", "offset"):
            if not value.isdecimal():
                raise ValueError(f"{name} is no number: {value!r}")
            counts[name] = int(value)
        else:
            table = table.where(condition(f"`{known(name)}`", kinds[name], value))
    if order:
        table = table.orderBy(*order)
    if "offset" in counts:
        table = table.offset(counts["offset"])
    if "limit" in counts:
        table = table.limit(counts["limit"])
    return table.select(*chosen)


def write_row_snapshot(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, one file per task."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_row_snapshot(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON snapshot under an explicit schema."""
    return spark.read.schema(schema).json(path)
