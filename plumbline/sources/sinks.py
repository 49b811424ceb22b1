"""Writers: partitioned trees, tables, manifests and samples."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.contracts import checked
from plumbline.sources.readers import HIVE_NULL
from plumbline.sources.versions import publish


def add_year_partition(df: DataFrame, date_column: str, name: str = "year") -> DataFrame:
    """The partition key an archive without one gets: the year of its received date."""
    return df.withColumn(name, F.substring(F.col(f"`{date_column}`"), 1, 4))


def _filesystem(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target.getFileSystem(spark._jsc.hadoopConfiguration())


def write_partitioned(df: DataFrame, path: str, key: str, keep: int = 2, grace: float = 3600.0) -> int:
    """Truncate and reload a partitioned tree as its next version; returns the rows that readers now find.

    A failed job leaves the version before it. What else lies in ``path``, such as a manifest, stays.
    """
    folder = publish(df, path, key, keep, grace)
    return df.sparkSession.read.schema(df.schema).parquet(folder).count()


def partition_counts(df: DataFrame, key: str | Column) -> DataFrame:
    """Rows per partition, the NULL partition named rather than dropped."""
    column = F.col(f"`{key}`") if isinstance(key, str) else key
    return df.groupBy(
        F.coalesce(column.cast("string"), F.lit(HIVE_NULL)).alias("partition_key")
    ).agg(F.count(F.lit(1)).alias("row_count"))


def flag_nonstandard_keys(counts: DataFrame, reference: DataFrame | None = None,
                          years: tuple[int, int] | None = None) -> DataFrame:
    """Mark keys outside a code list, or outside a plausible range of years. None is removed."""
    if reference is not None:
        known = reference.select(F.col(reference.columns[0]).alias("partition_key")).distinct()
        return counts.join(known.withColumn("known", F.lit(True)), "partition_key", "left").select(
            "partition_key", "row_count", F.col("known").isNull().alias("is_nonstandard"))
    first, last = years or (1900, 2100)
    year = F.when(F.col("partition_key").rlike("^[0-9]{4}$"), F.col("partition_key").try_cast("int"))
    return counts.withColumn("is_nonstandard", ~F.coalesce(year.between(first, last), F.lit(False)))


def save_table(df: DataFrame, name: str, comments: Mapping[str, str] | None = None,
               path: str | None = None) -> DataFrame:
    """Write a mart or dimension under its own schema, with descriptions of it and its columns.

    A table that has a contract is refused, before anything is written, if its columns differ
    from it; its descriptions are the contract's, over which ``comments`` go.
    """
    spark = df.sparkSession
    contract = checked(df, name)
    known = {**(contract.comments if contract else {}), **(comments or {})}
    schema, _, _ = name.rpartition(".")
    if schema:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    columns = [
        F.col(f"`{f.name}`").alias(f.name, metadata={"comment": known[f.name]})
        if f.name in known else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    writer = df.select(*columns).write.mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    if contract:
        spark.sql(f"COMMENT ON TABLE {name} IS :meaning", {"meaning": contract.meaning})
    return spark.table(name)


def publish_view(df: DataFrame, name: str) -> DataFrame:
    """Staging and intermediate layers stay views: nothing is written for them."""
    df.createOrReplaceTempView(name)
    return df


def manifest_row(counts: DataFrame, source_reported_count: int | None = None,
                 source_last_refresh: str | None = None, source_metadata_refresh: str | None = None,
                 rows_landing: int | None = None, rows_duckdb: int | None = None, retrieved_at: str | None = None,
                 **more: object) -> DataFrame:
    """The provenance record of a load, from its partition counts, in one pass.

    ``rows_landing`` counts what was received and ``rows_duckdb`` what the warehouse table
    holds; left out, they are the rows of the tree. ``more`` are further facts of the source. The rows per
    partition are listed, so the key must be one that partitions a tree, with few values.
    """
    is_null = F.col("partition_key") == HIVE_NULL
    return counts.agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows_raw"),
        F.count(F.lit(1)).alias("partitions"),
        F.coalesce(F.sum(F.when(is_null, F.col("row_count"))), F.lit(0)).alias("null_partition_rows"),
        F.coalesce(F.sum(F.when(F.col("is_nonstandard"), F.col("row_count"))), F.lit(0))
        .alias("nonstandard_rows"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("partition_key", "row_count")))).alias("partition_rows"),
        F.array_sort(F.collect_list(F.when(F.col("is_nonstandard"), F.col("partition_key")))).alias("nonstandard_partition_keys"),
    ).select(
        "*",
        F.coalesce(F.lit(rows_landing).cast("bigint"), "rows_raw").alias("rows_landing"),
        F.coalesce(F.lit(rows_duckdb).cast("bigint"), "rows_raw").alias("rows_duckdb"),
        F.lit(retrieved_at).cast("string").alias("retrieved_at"),
        *[F.lit(value).alias(name) for name, value in more.items()],
        F.lit(source_reported_count).cast("bigint").alias("source_reported_count"),
        F.lit(source_last_refresh).cast("string").alias("source_last_refresh"),
        F.lit(source_metadata_refresh).cast("string").alias("source_metadata_refresh"),
    )


def write_manifest(row: DataFrame, path: str) -> None:
    """One aggregated row as a JSON file beside the tree."""
    spark = row.sparkSession
    text = json.dumps(row.first().asDict(), indent=2, default=str)
    jvm, fs = _filesystem(spark, path)
    stream = fs.create(jvm.org.apache.hadoop.fs.Path(path), True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def write_sample(df: DataFrame, path: str, form: str, order: list[str] | None = None,
                 envelope: str = "results", limit: int = 10_000) -> None:
    """Write a bounded sample in its publisher's form, in a stable order.

    One output file is one task, so more than ``limit`` rows are refused.
    """
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"a sample has at most {limit} rows")
    ordered = df.orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in order]) if order else df
    one = ordered.coalesce(1)
    writer = one.write.mode("overwrite")
    if form == "parquet":
        writer.parquet(path)
    elif form == "csv":
        writer.csv(path, header=True, escape='"')
    elif form == "tsv":
        writer.csv(path, header=True, sep="\t", quote="",
                   ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    elif form == "json_envelope":
        # One document is what the publisher serves, so the sampled rows form one array.
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        first = F.struct(*[x for c in order or [] for x in (F.col(f"`{c}`").isNull().alias(f"no {c}"), F.col(f"`{c}`").alias(c))], row.alias("row"))
        rows = df.agg(F.sort_array(F.collect_list(first)).alias("sorted"))
        rows.select(F.struct(F.col("sorted.row").alias(envelope)).alias("data")).write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown sample form {form!r}")
