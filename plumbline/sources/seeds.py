"""Small lookup tables with every column pinned to text."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import fixed_values


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def parse_fixed(text: str) -> tuple[list[str], list[tuple[str | None, ...]]]:
    header, *lines = [line.split("|") for line in text.strip("\n").split("\n")]
    return header, [tuple(value or None for value in line) for line in lines]


def _literal(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


_RELATIONS: WeakKeyDictionary[SparkSession, dict[str, DataFrame]] = WeakKeyDictionary()


def fixed_table(spark: SparkSession, text: str) -> DataFrame:
    """A fixed list as a constant relation, whose size the optimizer therefore knows."""
    known = _RELATIONS.setdefault(spark, {})
    if text not in known:
        header, rows = parse_fixed(text)
        values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
        columns = ", ".join(f"CAST({c} AS STRING) AS {c}" for c in header)
        known[text] = spark.sql(f"SELECT {columns} FROM VALUES {values} AS seed({', '.join(header)})")
    return known[text]


def literal_map(pairs: dict[str, str]) -> Column:
    """A constant map column."""
    cells = ", ".join(f"{_literal(k)}, {_literal(v)}" for k, v in pairs.items())
    return F.expr(f"map({cells})")


def seed_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A seed kept outside the package, read without inference so ``02`` stays ``02``."""
    return spark.read.schema(text_schema(columns)).csv(path, header=True, escape='"')


def code_list(list_name: str) -> dict[str, str]:
    _, rows = parse_fixed(fixed_values.LENDING_CODES)
    return {code: label for name, code, label in rows if name == list_name}


def fixed_map(text: str, key: str, value: str) -> dict[str, str]:
    """One column of a fixed list keyed by another, for literal-map decoding."""
    header, rows = parse_fixed(text)
    k, v = header.index(key), header.index(value)
    return {row[k]: row[v] for row in rows if row[k] is not None and row[v] is not None}
