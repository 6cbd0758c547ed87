"""Keys and references: existence filters, orphan counts, constraint checks and cascades.

Key sides are made distinct before they meet the other table, so a repeated key costs one row per map
task. No side is broadcast by hint: Spark decides from measured sizes, and AQE splits skewed keys.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_existing(df: DataFrame, column: str, parents: DataFrame, parent_key: str = "id") -> DataFrame:
    """Rows whose reference exists among the parents."""
    keys = parents.select(F.col(parent_key).alias(column)).distinct()
    return df.join(keys, column, "left_semi")


def orphans(df: DataFrame, column: str, parents: DataFrame, parent_key: str = "id") -> DataFrame:
    """Distinct non-null references without a parent."""
    mine = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return mine.join(parents.select(F.col(parent_key).alias(column)).distinct(), column, "left_anti")


def orphan_report(checks: Iterable[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(relation, orphans) for each (label, child, column, parent, key)."""
    parts = [
        orphans(child, column, parent, key).agg(F.count("*").alias("orphans")).select(F.lit(label).alias("relation"), "orphans")
        for label, child, column, parent, key in checks
    ]
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class TableRules:
    """Declared constraints of one table; ``references`` maps a column to (table, key)."""

    primary_key: Sequence[str]
    not_null: Sequence[str] = ()
    unique: Sequence[str] = ()
    max_length: Mapping[str, int] | None = None
    references: Mapping[str, tuple[str, str]] | None = None


def violations(name: str, df: DataFrame, rules: TableRules, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """One row per declared constraint with the number of offending rows (0 when it holds).

    Row-level checks share a single pass; each key check is one partially combined aggregation.
    """
    per_row = {f"not_null:{c}": F.col(c).isNull() for c in (*rules.primary_key, *rules.not_null)}
    per_row |= {f"max_length:{c}": F.length(c) > n for c, n in (rules.max_length or {}).items()}
    counted = df.agg(*[F.count_if(F.coalesce(cond, F.lit(False))).alias(label) for label, cond in per_row.items()])
    cells = [F.struct(F.lit(k).alias("constraint"), F.col(f"`{k}`").alias("offending")) for k in per_row]
    parts = [counted.select(F.inline(F.array(*cells)))]

    def repeated(label: str, key: Sequence[str], present: bool) -> DataFrame:
        rows = df.dropna(subset=list(key)) if present else df
        groups = rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
        total = groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("offending"))
        return total.select(F.lit(label).alias("constraint"), "offending")

    parts.append(repeated("primary_key:" + ",".join(rules.primary_key), rules.primary_key, False))
    parts += [repeated(f"unique:{c}", [c], True) for c in rules.unique]
    for column, (table, key) in (rules.references or {}).items():
        mine = df.groupBy(column).agg(F.count("*").alias("n")).filter(F.col(column).isNotNull())
        lost = mine.join(tables[table].select(F.col(key).alias(column)).distinct(), column, "left_anti")
        parts.append(
            lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("offending")).select(
                F.lit(f"references:{column}->{table}.{key}").alias("constraint"), "offending"
            )
        )
    return reduce(DataFrame.unionByName, parts).select(F.lit(name).alias("table"), "constraint", "offending")


def insert_violations(name: str, batch: DataFrame, stored: DataFrame | None, rules: TableRules, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """``violations`` of the batch, and one row per key with the batch's rows whose key is stored already."""
    report = violations(name, batch, rules, tables)
    if stored is None:
        return report
    for label, key in [("primary_key:" + ",".join(rules.primary_key), rules.primary_key), *[(f"unique:{c}", [c]) for c in rules.unique]]:
        clash = batch.dropna(subset=list(key)).join(stored.select(*key).distinct(), list(key), "left_semi")
        counted = clash.agg(F.count("*").alias("offending"))
        report = report.unionByName(counted.select(F.lit(name).alias("table"), F.lit(f"stored_{label}").alias("constraint"), "offending"))
    return report


class ConstraintError(ValueError):
    """Raised when a table breaks its declared constraints."""


def enforce(name: str, df: DataFrame, rules: TableRules, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Return the table unchanged, or raise with the broken constraints (one small row each)."""
    return _raise(violations(name, df, rules, tables)) or df


def enforce_insert(name: str, batch: DataFrame, stored: DataFrame | None, rules: TableRules, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Return the batch unchanged, or raise with the constraints that adding it to the stored rows would break."""
    return _raise(insert_violations(name, batch, stored, rules, tables)) or batch


def _raise(report: DataFrame) -> None:
    broken = report.filter("offending > 0").collect()
    if broken:
        raise ConstraintError("; ".join(f"{r['table']} {r['constraint']}: {r['offending']}" for r in broken))


def delete_cascade(df: DataFrame, column: str, deleted: DataFrame, deleted_key: str = "id") -> DataFrame:
    """Drop the rows that refer to a deleted parent."""
    keys = deleted.select(F.col(deleted_key).alias(column)).distinct()
    return df.join(keys, column, "left_anti").select(df.columns)


def delete_set_null(df: DataFrame, column: str, deleted: DataFrame, deleted_key: str = "id") -> DataFrame:
    """Keep the rows that refer to a deleted parent, with the reference cleared."""
    keys = deleted.select(F.col(deleted_key).alias("_gone")).distinct()
    joined = df.join(keys, F.col(column) == F.col("_gone"), "left")
    return joined.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(df.columns)
