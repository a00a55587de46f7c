"""CSV scans. Lines are split inside the JVM, in parallel, by the layout's own rules."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from kickpool.functions.text import WS, strip_ws

# No text holds this, so the CSV reader hands over whole lines and still drops each file's header.
NO_SEPARATOR = "\x01\x02\x01"
# A field: quoted stretches (to the end of the line when left open) and anything but commas.
# Possessive, so a long field costs no backtracking and no deep recursion.
QUOTED_FIELD = r'((?:[^",]++|"[^"]*+(?:"|\z))*+)(?:,|\z)'
# Different header lines of one read; they are parsed on the driver.
MOST_LAYOUTS = 10_000
HEADER_EDGES = re.compile(f"^{WS}+|{WS}+$")


def header_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, header``: the first line of each file that is not blank, in its first block.

    Only lines of first blocks are looked at, and each task keeps one of them a file.
    """
    lines = spark.read.option("lineSep", "\n").text(path).where("_metadata.file_block_start = 0")
    placed = lines.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    first = placed.where("trim(value) <> '' AND value <> '\\r'").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    return first.withColumn("header", F.regexp_replace("header", r"\r$", ""))


def data_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, line`` of all lines but each file's header."""
    shape = T.StructType([T.StructField("line", T.StringType())])
    reader = spark.read.schema(shape).option("sep", NO_SEPARATOR).option("quote", "").option("header", True)
    return reader.option("lineSep", "\n").csv(path).select(F.col("_metadata.file_path").alias("file"), "line")


def read_by_header(
    spark: SparkSession,
    path: str | list[str],
    names_of: Callable[[str], list[str]],
    split: Callable[[Column], Column],
) -> DataFrame:
    """Rows of files that may each have columns of their own, or another order of them.

    The columns are those of all files, in the order in which the sorted header lines name them.
    A row's values are found through its own file's header: of equal names the last wins, a short
    line is padded with empty text, and a column that the file does not have is NULL. Files of
    one layout need no more than their lines; otherwise lines meet the place of each column in
    their file, a relation of one row a file.
    """
    headers = header_lines(spark, path)
    layouts = sorted(r.header for r in headers.select("header").distinct().limit(MOST_LAYOUTS + 1).collect())
    if len(layouts) > MOST_LAYOUTS:
        raise ValueError(f"more than {MOST_LAYOUTS} header lines")
    names = list(dict.fromkeys(name for header in layouts for name in names_of(header)))
    values = data_lines(spark, path).withColumn("v", F.transform(split(F.col("line")), strip_ws))
    if len(layouts) == 1:
        place = {name: i for i, name in enumerate(names_of(layouts[0]))}
        return values.select(*(_value(F.lit(place[name])).alias(name) for name in names))
    places = []
    for header in layouts:
        place = {name: i for i, name in enumerate(names_of(header))}
        places.append((header, [place.get(name) for name in names]))
    places = spark.createDataFrame(places, "header string, places array<int>")
    # Broadcast by hint: at most MOST_LAYOUTS rows. The files are left to the planner's size check.
    by_file = headers.join(F.broadcast(places), "header").select("file", "places")
    unknown = F.raise_error(F.concat(F.lit("no header in the first block of "), "file"))
    rows = values.join(by_file, "file", "left").withColumn("places", F.coalesce("places", unknown.cast("array<int>")))
    return rows.select(*(_value(F.get("places", F.lit(i))).alias(name) for i, name in enumerate(names)))


def _value(place: Column) -> Column:
    found = F.coalesce(F.get("v", place), F.lit(""))
    return F.when(place.isNotNull(), found)


def split_quoted(line: Column) -> Column:
    """Fields of a line where a quote anywhere toggles quoting and is itself dropped."""
    fields = F.regexp_extract_all(line, F.lit(QUOTED_FIELD), F.lit(1))
    return F.transform(fields, lambda f: F.replace(f, F.lit('"'), F.lit("")))


def read_quoted_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with quoting, all columns text. Quoted line breaks do not exist in this layout."""
    return read_by_header(spark, path, quoted_fields, split_quoted)


def quoted_fields(line: str) -> list[str]:
    """Header names by the rule of ``split_quoted``."""
    names = [""]
    quoted = False
    for char in line:
        if char == '"':
            quoted = not quoted
        elif char == "," and not quoted:
            names.append("")
        else:
            names[-1] += char
    return [HEADER_EDGES.sub("", name) for name in names]


def plain_fields(line: str) -> list[str]:
    return [HEADER_EDGES.sub("", name) for name in line.split(",")]


def read_plain_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV where every comma separates and a quote is an ordinary character."""
    return read_by_header(spark, path, plain_fields, lambda line: F.split(line, ",", -1))
