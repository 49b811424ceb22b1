"""Readers that land every published shape as text, and one for typed parquet."""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import SETTINGS, Scratch, delete_folders, materialise, put_on_workers_path
from plumbline.sources.seeds import text_schema
from plumbline.sources.versions import published_folder

HIVE_NULL = "__HIVE_DEFAULT_PARTITION__"


def header_of(spark: SparkSession, path: str, separator: str = ",", quote: str = '"') -> list[str]:
    """Column names in file order; reads one line, infers nothing."""
    return spark.read.csv(path, header=True, inferSchema=False, sep=separator, quote=quote,
                          escape='"').columns


def read_csv_text(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None,
                  multi_line: bool = False) -> DataFrame:
    """Delimited files with every column as text.

    ``multi_line`` reads each file in one task and allows newlines inside quotes;
    ``quoted_csv.read_quoted_csv`` reads such files block by block.
    """
    first = path if isinstance(path, str) else path[0]
    names = list(columns) if columns is not None else header_of(spark, first)
    return spark.read.schema(text_schema(names)).csv(
        path, header=True, escape='"', multiLine=multi_line, enforceSchema=columns is None)


def read_tsv_text(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Tab-separated files without quoting; padding stays byte for byte."""
    first = path if isinstance(path, str) else path[0]
    names = list(columns) if columns is not None else header_of(spark, first, "\t", "")
    return spark.read.schema(text_schema(names)).csv(
        path, header=True, sep="\t", quote="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _whole_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    # One response is one row. Responses are a few MB; the files spread over tasks.
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias("body"), F.input_file_name().alias("file"))


def numbers_as_text(body: Column) -> Column:
    """Quote bare JSON numbers, so ``1.50`` and ``0.00001`` keep the digits they came with.

    Strings are matched first and whole, so digits inside one are never touched. Every match
    is closed with a control character JSON cannot contain: a pair marks a string, which
    stays as it is, and a single one marks either end of a number and becomes its quote.
    """
    string = r'"(?:[^"\\]++|\\.)*+"'
    number = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
    marked = F.regexp_replace(body, f"({string})|({number})", "$1\u0001$2\u0001")
    return F.regexp_replace(F.regexp_replace(marked, "\u0001\u0001", ""), "\u0001", '"')


def read_json_arrays(spark: SparkSession, path: str | list[str], variables: Sequence[str],
                     geo_level: str) -> DataFrame:
    """A response of rows-as-arrays whose first row is the header, read by position.

    The vintage is the four digits before the geography in the file name. Use
    :func:`json_array_headers` first to prove the positions.
    """
    keys = {"us": ["us"], "state": ["state"], "county": ["state", "county"]}[geo_level]
    names = ["NAME", *variables, *keys]
    rows = (
        _whole_files(spark, path)
        .withColumn("rows", F.from_json("body", "array<array<string>>"))
        .select("file", F.posexplode("rows").alias("pos", "cells"))
        .where(F.col("pos") > 0)
    )
    return rows.select(
        *[F.col("cells")[i].alias(name) for i, name in enumerate(names)],
        F.lit(geo_level).alias("geo_level"),
        F.regexp_extract("file", r"-(\d{4})-[a-z]+\.json", 1).alias("vintage"),
    )


def json_array_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The first row of every file, to be compared with the positions about to be trusted."""
    return _whole_files(spark, path).select(
        "file", F.from_json("body", "array<array<string>>")[0].alias("header"))


def read_population_vintages(spark: SparkSession, folder: str, dataset: str,
                             variables: Sequence[str]) -> DataFrame:
    """Nation, state and county responses as one table; absent geography keys are NULL."""
    parts = [
        read_json_arrays(spark, f"{folder}/*acs5-{dataset}-*-{level}.json", variables, level)
        for level in ("us", "state", "county")
    ]
    return union_by_name(parts)


def union_by_name(parts: Sequence[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def read_json_envelope(spark: SparkSession, path: str | list[str], array_path: str,
                       fields: Sequence[str], keep_number_text: bool = True) -> DataFrame:
    """Rows of an array inside a response object, every field as text."""
    row = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    schema: T.DataType = T.ArrayType(row)
    for step in reversed(array_path.split(".")):
        schema = T.StructType([T.StructField(step, schema)])
    files = _whole_files(spark, path)
    body = numbers_as_text(F.col("body")) if keep_number_text else F.col("body")
    parsed = files.select(F.from_json(body, schema).alias("doc"))
    return parsed.select(F.inline(f"doc.{array_path}"))


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """A hive-partitioned tree whose key stays text and whose NULL partition stays NULL.

    Of a published tree it is the version that is newest now; a frame keeps reading that one.
    """
    key = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, SETTINGS[key])
    try:
        # A tree that was not published may hold its manifest, which is not data.
        return spark.read.option("pathGlobFilter", "*.parquet").parquet(published_folder(spark, path) or path)
    finally:
        spark.conf.set(key, before)


def read_manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.json(path, multiLine=True)


#: Bytes of a file that one task may hold as one value, and about as many that one step of a chained digest takes.
WHOLE = 512 << 20


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and sha256 of each landed file.

    A SHA-256 is one chain over the bytes. A file above ``WHOLE`` bytes is digested in steps, each by a
    task that reads only its own part and hands the state of the chain on (``chained_sha256``).
    """
    files = spark.read.format("binaryFile").load(path)
    name, size = F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("bytes")
    if sha256_states() is None:
        return files.select(name, size, F.sha2("content", 256).alias("sha256"))
    chained, others = [], []
    for file, length in files.where(F.col("length") > WHOLE).select("path", "length").collect():
        literal = re.sub(r"([][{}*?\\])", r"\\\1", file)
        digest = chained_sha256(spark, literal, length)
        chained += [] if digest is None else [F.lit(file), F.lit(digest)]
        others += [literal] if digest is None else []
    # Spark's reader takes no content of files that a condition on ``length`` leaves out.
    parts = [files.where(F.col("length") <= WHOLE), *([spark.read.format("binaryFile").load(others)] if others else [])]
    found = [part.select(name, size, F.sha2("content", 256).alias("sha256")) for part in parts]
    if chained:
        digest = F.create_map(*chained)[F.col("path")]
        found.append(files.where(F.col("length") > WHOLE).where(digest.isNotNull()).select(name, size, digest.alias("sha256")))
    return reduce(DataFrame.unionByName, found)


def chained_sha256(spark: SparkSession, file: str, size: int) -> str | None:
    """The digest of one file, read as lines by as many tasks as it has blocks; None where these are not all its bytes.

    That is so for a file whose name says that it is compressed, and for one that begins with a byte order mark.
    """
    text = spark.read.text(file, lineSep="\n").select(
        F.expr("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"),
        F.col("value").cast("binary").alias("line"))
    with Scratch(spark) as scratch:
        lines = materialise(text.withColumn("step", F.expr(f"cast(block div {WHOLE} as int)")), "file-lines")
    put_on_workers_path(spark)
    state, n = None, 0
    try:
        for step in range(-(-size // WHOLE)):
            own = lines.where(F.col("step") == step).select("block", "place", "line")
            rows = own.coalesce(1).sortWithinPartitions("block", "place").select("line").mapInArrow(
                _sha256_step(state), "state binary, n long").collect()
            for row in rows:
                state, n = bytes(row.state), n + row.n
    finally:
        delete_folders(spark, scratch.folders)
    if state is None or n not in (size, size + 1):
        return None
    # Every line was taken with a line feed behind it but the last, which may have none.
    return sha256_states()(state, b"\n" if n == size else b"", True).hex()


def _sha256_step(state: bytes | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        update, now, n = sha256_states(), state, 0
        for batch in batches:
            if batch.num_rows:
                data = b"\n".join([*([] if now is None else [b""]), *batch.column(0).to_pylist()])
                now, n = update(now, data, False), n + len(data) + (now is None)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([n], pa.int64())], names=["state", "n"])

    return run


def sha256_states() -> Callable[[bytes | None, bytes, bool], bytes] | None:
    """``update(state, data, end)``: the next state of a SHA-256, or at its end the digest. None without OpenSSL's library.

    hashlib does not give out its state; OpenSSL's SHA256_CTX is one plain struct of 112 bytes.
    """
    name = ctypes.util.find_library("crypto")
    try:
        library = ctypes.CDLL(name) if name else None
        functions = library and (library.SHA256_Init, library.SHA256_Update, library.SHA256_Final)
    except (OSError, AttributeError):
        return None
    if not functions:
        return None
    init, add, final = functions
    add.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
    init.argtypes, final.argtypes = [ctypes.c_void_p], [ctypes.c_char_p, ctypes.c_void_p]

    def update(state: bytes | None, data: bytes, end: bool) -> bytes:
        context = ctypes.create_string_buffer(state or b"", 112)
        if state is None:
            init(context)
        add(context, data, len(data))
        if not end:
            return context.raw
        digest = ctypes.create_string_buffer(32)
        final(digest, context)
        return digest.raw

    if update(update(None, b"a", False), b"bc", True) != hashlib.sha256(b"abc").digest():
        return None
    return update
