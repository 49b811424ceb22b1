"""The few spellings in which Spark SQL and DuckDB differ, so one text can feed both."""

from __future__ import annotations

from dataclasses import dataclass

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Twenty-five jurisdictions stand in for the twenty-five nations; nation 22 is the focus state.
STATE_CODES = "ALAKAZARCACOCTDEFLGAHIIDILINIAKSKYLAMEMDMAMNMIMSMO"
STATE_FIPS = "01020405060809101213151617181920212223242527262829"


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def table(self, name: str) -> str:
        return "{" + name + "}" if self.spark else name

    def plus_days(self, day: str, days: str) -> str:
        if self.spark:
            return f"date_add({day}, CAST({days} AS INT))"
        return f"CAST({day} + CAST({days} AS INTEGER) AS DATE)"

    def days_between(self, begin: str, end: str) -> str:
        return f"datediff({end}, {begin})" if self.spark else f"date_diff('day', {begin}, {end})"

    @staticmethod
    def state(index: str) -> str:
        return f"substr('{STATE_CODES}', CAST({index} AS INT) * 2 + 1, 2)"

    @staticmethod
    def fips(index: str) -> str:
        return f"substr('{STATE_FIPS}', CAST({index} AS INT) * 2 + 1, 2)"

    @staticmethod
    def pick(index: str, values: list[str | None]) -> str:
        """The value at a position, as text."""
        whens = " ".join(
            f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'")
            for i, v in enumerate(values))
        return f"CASE CAST({index} AS INT) {whens} END"

    @staticmethod
    def text(number: str) -> str:
        return f"CAST({number} AS STRING)"

    @staticmethod
    def county3(index: str) -> str:
        return f"lpad(CAST(1 + 2 * ({index}) AS STRING), 3, '0')"

    @staticmethod
    def floor_div(part: str, whole: str) -> str:
        """Whole quotient by way of doubles, which both engines divide alike."""
        return f"CAST(floor(CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE)) AS BIGINT)"

    @classmethod
    def tenths(cls, value: str) -> str:
        """A whole number of tenths as ``12.3``, without rounding."""
        return f"{cls.text(cls.floor_div(value, '10'))} || '.' || {cls.text(f'({value}) % 10')}"


SPARK = Dialect(spark=True)
DUCKDB = Dialect(spark=False)
