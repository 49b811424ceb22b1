"""The data dictionary: one row per column of every catalogued table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import blank_to_null

COLUMNS = ("schema_name string, relation_name string, relation_kind string, ordinal_position int, "
           "column_name string, data_type string, is_nullable boolean, relation_comment string, "
           "column_comment string")


def catalogue_rows(spark: SparkSession, schemas: list[str] | None = None) -> DataFrame:
    """Columns as the catalogue knows them. Metadata only; no table is read.

    Temporary views lie in no schema; every schema lists them, and they count once, in the current one.
    """
    rows, current = [], spark.catalog.currentDatabase()
    for database in spark.catalog.listDatabases():
        if schemas is not None and database.name not in schemas:
            continue
        for table in spark.catalog.listTables(database.name):
            if table.isTemporary and database.name != current:
                continue
            name = table.name if table.isTemporary else f"{database.name}.{table.name}"
            kind = "view" if table.tableType in ("VIEW", "TEMPORARY") else "table"
            for position, column in enumerate(spark.catalog.listColumns(name), start=1):
                rows.append((database.name, table.name, kind, position, column.name, column.dataType,
                             column.nullable, table.description, column.description))
    return spark.createDataFrame(rows, COLUMNS)


def data_dictionary(rows: DataFrame) -> DataFrame:
    """Layer and track follow from where a table lives and how it is named."""
    schema, name = F.col("schema_name"), F.col("relation_name")
    layers = {"raw": "raw", "stg": "staging", "int": "intermediate", "conformed": "conformed",
              "seeds": "seed", "meta": "meta"}
    layer = F.when(schema.startswith("mart_"), "mart")
    for key, value in layers.items():
        layer = layer.when(schema == key, value)
    track = F.lit("shared")
    for prefix, value in (("hlt", "health"), ("fin", "fintech"), ("ins", "insurance")):
        owned = (
            (schema == f"mart_{prefix}") | name.startswith(f"stg_{prefix}__")
            | name.startswith(f"{prefix}_") | name.startswith(f"int_{prefix}__"))
        track = F.when(owned, value).otherwise(track)
    described = blank_to_null(F.col("column_comment"))
    return rows.select(
        "schema_name", "relation_name", "relation_kind", layer.otherwise("other").alias("layer"),
        track.alias("track"), "ordinal_position", "column_name", "data_type", "is_nullable",
        blank_to_null(F.col("relation_comment")).alias("relation_description"),
        described.alias("column_description"), described.isNotNull().alias("is_documented"))
