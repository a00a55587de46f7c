"""Constraint checks that report violations as rows, and cascading deletes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from kickpool.functions.text import strip_ws
from kickpool.sources.schemas import TABLE_RULES


def _report(rows: DataFrame, table: str, rule: Column, key: Sequence[str], n: Column) -> DataFrame:
    key_parts = (F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key)
    return rows.select(
        F.lit(table).alias("table_name"),
        rule.alias("rule"),
        F.concat_ws("|", *key_parts).alias("row_key"),
        n.cast("bigint").alias("row_count"),
    )


def with_parent_mark(child: DataFrame, parent: DataFrame, on: Sequence[str], mark: str) -> DataFrame:
    """Child rows with a mark where the complete reference has a parent row."""
    keys = parent.select(*on).distinct().withColumn(mark, F.lit(True))
    return child.join(keys, list(on), "left")


def has_null(on: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(k).isNull() for k in on))


def row_violations(
    df: DataFrame,
    table: str,
    key: Sequence[str],
    not_null: Sequence[str] = (),
    allowed: dict[str, Sequence[str]] | None = None,
    references: Mapping[tuple[str, ...], DataFrame] | None = None,
    not_blank: Sequence[str] = (),
) -> DataFrame:
    """Rows that break a rule of their own, in one scan: a NULL in a required column, a value
    outside its list, a blank text in a key, a complete reference without its parent row.

    A NULL passes all but the first check.
    """
    checks = [(f"not_null:{c}", F.col(c).isNull()) for c in not_null]
    checks += [(f"not_blank:{c}", strip_ws(c) == "") for c in not_blank]
    checks += [(f"allowed:{c}", ~F.col(c).isin(*values)) for c, values in (allowed or {}).items()]
    for i, (on, parent) in enumerate((references or {}).items()):
        df = with_parent_mark(df, parent, on, f"_parent_{i}")
        checks.append(("reference:" + ",".join(on), F.col(f"_parent_{i}").isNull() & ~has_null(on)))
    broken = F.array(*(F.when(fails, F.lit(rule)) for rule, fails in checks))
    rows = df.withColumn("_rule", F.explode(F.array_compact(broken)))
    return _report(rows, table, F.col("_rule"), key, F.lit(1))


def unique_violations(df: DataFrame, table: str, key: Sequence[str]) -> DataFrame:
    """Complete keys that occur more than once, with their count. NULL keys never clash."""
    complete = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key))
    twice = df.where(complete).groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1")
    return _report(twice, table, F.lit("unique:" + ",".join(key)), key, F.col("_n"))


def orphans(child: DataFrame, parent: DataFrame, on: Sequence[str]) -> DataFrame:
    """Child rows whose complete reference has no parent row."""
    complete = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in on))
    return child.where(complete).join(parent.select(*on), list(on), "left_anti")


def reference_violations(
    child: DataFrame, parent: DataFrame, table: str, on: Sequence[str], key: Sequence[str]
) -> DataFrame:
    lost = orphans(child, parent, on)
    return _report(lost, table, F.lit("reference:" + ",".join(on)), key, F.lit(1))


def violations(*parts: DataFrame) -> DataFrame:
    """All reports as one relation."""
    return reduce(DataFrame.unionByName, parts)


def table_violations(
    df: DataFrame, table: str, parents: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """All violations of a stored table's rules, as far as its columns and parents are given."""
    rules = TABLE_RULES[table]
    allowed = {c: values for c, values in rules.allowed.items() if c in df.columns}
    given = parents or {}
    references = {on: given[name] for name, on in rules.references.items() if name in given}
    blank = [c for c in rules.key if isinstance(df.schema[c].dataType, StringType)]
    return violations(
        row_violations(df, table, rules.key, rules.not_null, allowed, references, blank),
        unique_violations(df, table, rules.key),
    )


def cascade_delete(child: DataFrame, kept_parents: DataFrame, on: Sequence[str]) -> DataFrame:
    """Child rows that survive the deletion of every parent that is not kept.

    A row with a NULL reference belongs to no parent and stays.
    """
    marked = with_parent_mark(child, kept_parents, on, "_kept")
    return marked.where(F.col("_kept") | has_null(on)).select(*child.columns)
