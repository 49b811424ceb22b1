"""Check results: one row per check, tallied once at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASS, WARN, SKIP, FAIL = "PASS", "WARN", "SKIP", "FAIL"


def results(frame: DataFrame, track: str, source: str,
            *checks: tuple[str, Column | str, Column]) -> DataFrame:
    """The outcomes of checks measured together in a one-row frame: one scan, many rows."""
    rows = F.array(*[
        F.struct(F.lit(track).alias("track"), F.lit(source).alias("source"), F.lit(check).alias("check_name"),
                 (F.lit(status) if isinstance(status, str) else status).alias("status"),
                 detail.alias("detail"))
        for check, status, detail in checks])
    return frame.select(F.inline(rows))


def passes(condition: Column, otherwise: str = FAIL) -> Column:
    return F.when(condition, PASS).otherwise(otherwise)


def counted(**counts: Column) -> Column:
    """``name=value`` pairs, so a detail reads the same wherever it was computed."""
    return F.concat_ws(", ", *[
        F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit("none")))
        for name, value in counts.items()])


def tally(results: DataFrame) -> DataFrame:
    """Statuses per track and source."""
    status = F.col("status")
    return results.groupBy("track", "source").agg(*[
        F.count_if(status == s).alias(s.lower()) for s in (PASS, WARN, SKIP, FAIL)])


def exit_code(results: DataFrame) -> int:
    """1 when anything failed; only the first failing row travels to the driver."""
    return 0 if results.where(F.col("status") == FAIL).limit(1).count() == 0 else 1


def coverage_status(condition: Column, is_sample: bool, otherwise: str = FAIL) -> Column:
    """A coverage claim cannot be put to a stratified sample, so there it is skipped."""
    return F.lit(SKIP) if is_sample else passes(condition, otherwise)
