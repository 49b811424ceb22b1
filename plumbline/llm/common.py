"""What several operators share: words, running totals, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import materialise, put_on_workers_path

#: A word is a run of anything but ASCII white space; ``bytes.split()`` cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch: whole texts travel in them, and both ends hold one.
BATCH_ROWS = 2000


def let_workers_import(spark: SparkSession) -> None:
    """Python workers of a local session find this package where the driver found it, and get texts in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    put_on_workers_path(spark)


def give_back_memory() -> None:
    """Freed memory of this worker goes back to the machine, since an idle worker would keep it beside the next stage's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has this call
        ctypes.CDLL(None).malloc_trim(0)


#: Column of ``with_row_key``.
ROW_KEY = "_row_key"


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number of its own for every row, written so that each later read finds the same numbers."""
    return materialise(docs.withColumn(ROW_KEY, F.monotonically_increasing_id()), name)


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def map_rows(df: DataFrame, function: Callable[..., list[tuple]], schema: str, setup: Callable | None = None,
             rows: int = 256) -> DataFrame:
    """Arrow batches through ``function(rows, state)``, at most ``rows`` rows at a time.

    Small slices keep a task's memory near the size of its longest texts, whatever the batch
    size. ``setup()`` runs once per task and gives ``state``.
    """
    target = _arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = function(list(zip(*[c.to_pylist() for c in part.columns], strict=True)), state)
                if out:
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)
        give_back_memory()

    return df.mapInArrow(run, schema)


def _arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def bucket_bits(n_rows: int, per_bucket: int = 20_000) -> int:
    """Bits of a hash that cut ``n_rows`` rows into buckets of about ``per_bucket``."""
    return min(40, max(0, math.ceil(math.log2(max(1, n_rows) / per_bucket))))


def running_total(df: DataFrame, keys: Sequence[str], hashed: str, tie: str, value: str, name: str, bits: int) -> DataFrame:
    """``value`` summed over the earlier rows of the same keys, in the order of ``hashed`` (64 bits), ``tie``.

    A window over a hot key would order it in one task. Here the top ``bits`` of the hash cut
    each key into buckets: bucket totals are summed first (few rows), and a window inside the
    bucket adds what is left. Both steps are keyed by the bucket, so rows move once. Keys may
    not be null.
    """
    bucket = F.shiftrightunsigned(F.col(hashed), 64 - bits) if bits else F.lit(0).cast("long")
    cut = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (cut.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"))
              .select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")))
    inside = (Window.partitionBy(*keys, "_bucket").orderBy(hashed, tie)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (cut.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(totals, [*keys, "_bucket"])
            .withColumn(name, (F.col("_before") + F.col("_inside")).cast("long"))
            .select(*df.columns, name))
