"""Text columns: cleaning, normalising, hashing."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.fixed_values import COMPANY_SUFFIXES
from plumbline.sources.seeds import literal_map


def snake_case(name: str) -> str:
    """``originalNBDate`` -> ``original_nb_date``, ``co-applicant_age`` -> ``co_applicant_age``."""
    name = re.sub(r"[\s\-]+", "_", name.strip())
    name = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return name.lower()


def blank_to_null(value: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(F.trim(value), F.lit(""))


def marker_to_null(value: Column, marker: str) -> Column:
    """Trimmed text, NULL when it is the publisher's "not available" marker."""
    return F.nullif(F.trim(value), F.lit(marker))


def normalize_company_name(name: Column) -> Column:
    """Lower-case words without punctuation or corporate suffixes; NULL when none remain.

    A suffix only counts after a blank, so a company called "Us" keeps its name, and the
    blank after a dropped suffix is used up with it.
    """
    words = F.regexp_replace(F.lower(name), "[^a-z0-9 ]", " ")
    core = F.regexp_replace(words, f" ({COMPANY_SUFFIXES})( |$)", " ")
    return F.nullif(F.trim(F.regexp_replace(core, " +", " ")), F.lit(""))


def row_text(columns: Iterable[str], separator: str = "|") -> Column:
    """The row as one text with NULLs spelled out, so two engines build the same string."""
    return F.concat_ws(
        separator, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in columns]
    )


def row_md5(columns: Iterable[str]) -> Column:
    return F.md5(row_text(columns).cast("binary"))


def has_tag(tags: Column, tag: str) -> Column:
    return F.coalesce(tags.contains(tag), F.lit(False))


_PART, _ESCAPE = "\u0001", "\u0002"


def packed(columns: Mapping[str, Sequence[str]]) -> Column:
    """Text columns as one short text: a value's place in the column's list of usual values, or the value itself.

    Equal texts mean equal rows, NULLs included, so the text may stand for the columns as a key.
    """
    def part(name: str, usual: Sequence[str]) -> Column:
        value = F.col(name)
        written = F.concat(F.lit("="), F.replace(F.replace(value, F.lit(_ESCAPE), F.lit(_ESCAPE + "b")), F.lit(_PART), F.lit(_ESCAPE + "a")))
        place = F.try_element_at(literal_map({v: str(n) for n, v in enumerate(usual)}), value) if usual else F.lit(None)
        return F.coalesce(place, written, F.lit(""))

    return F.concat_ws(_PART, *[part(name, usual) for name, usual in columns.items()])


def unpacked(text: Column, columns: Mapping[str, Sequence[str]]) -> list[Column]:
    """The columns that ``packed`` made into one text."""
    parts = F.split(text, _PART)

    def value(n: int, usual: Sequence[str]) -> Column:
        part = parts[n]
        written = F.replace(F.replace(F.substring(part, 2, 1 << 30), F.lit(_ESCAPE + "a"), F.lit(_PART)), F.lit(_ESCAPE + "b"), F.lit(_ESCAPE))
        known = F.try_element_at(literal_map({str(n): v for n, v in enumerate(usual)}), part) if usual else F.lit(None).cast("string")
        return F.when(part.startswith("="), written).otherwise(known)

    return [value(n, usual).alias(name) for n, (name, usual) in enumerate(columns.items())]
