"""Typing text columns without losing what the publisher wrote in them."""

from __future__ import annotations

import operator
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import blank_to_null
from plumbline.sources.seeds import literal_map


#: Every text that a cast to a number accepts, and a few that it refuses, such as ``1.2.3``.
NUMBER_SHAPE = (r"^[\x00-\x20\x7F]*[+-]?(?:\.?[0-9][0-9.]*(?:[eE][+-]?[0-9]+)?[fFdD]?|0[xX][^\n]*|(?i:inf|infinity|nan))"
                r"[\x00-\x20\x7F]*$")


def as_number(value: Column, words: Sequence[str] = ()) -> Column:
    """Text to double, NULL for what is none.

    A cast finds a word by an exception, which costs as much as many numbers, so the ``words``
    that a publisher is known to write for a number are not cast.
    """
    number = value.try_cast("double")
    return F.when(~value.isin(*words), number) if words else number


def banded_number(value: Column) -> Column:
    """The number in a column that mostly holds bands (``20%-<30%``), which are told by their shape."""
    return F.when(value.rlike(NUMBER_SHAPE), value.try_cast("double"))


def as_whole(value: Column) -> Column:
    """Text to bigint. ``36.5`` and ``1e3`` are numbers too, so they go through double."""
    return F.coalesce(value.try_cast("bigint"), F.round(value.try_cast("double")).try_cast("bigint"))


def banded_whole(value: Column) -> Column:
    """The whole number in a column that mostly holds bands (``5-24``)."""
    return F.when(value.rlike(NUMBER_SHAPE), as_whole(value))


def only(value: Column, allowed: Sequence[str]) -> Column:
    """The value when it is one of ``allowed``, else NULL."""
    return F.when(value.isin(*allowed), value)


def without(value: Column, refused: Sequence[str]) -> Column:
    """The value unless it is one of ``refused``."""
    return F.when(~value.isin(*refused), value)


def number_and_sentinel(name: str, raw: Column, sentinels: Sequence[str]) -> list[Column]:
    """``name`` as a number beside ``name_sentinel``, the word that stood in for one."""
    return [as_number(raw).alias(name), only(raw, sentinels).alias(f"{name}_sentinel")]


def any_true(conditions: Iterable[Column]) -> Column:
    """OR in which an unknown condition counts as false."""
    return F.coalesce(reduce(operator.or_, conditions), F.lit(False))


def suppressed_number(raw: Column, marker: str = "*") -> Column:
    return as_number(raw, (marker,))


def count_marked(columns: Iterable[Column], marker: str = "*") -> Column:
    """How many of the columns hold the suppression marker in this row."""
    return reduce(operator.add, [F.when(c == marker, 1).otherwise(0) for c in columns])


def blankable_number(raw: Column) -> Column:
    return as_number(blank_to_null(raw))


def is_blank(raw: Column) -> Column:
    return blank_to_null(raw).isNull()


def annotated_margin(raw: Column) -> Column:
    """A margin of error; negative values are annotations, not measurements."""
    margin = as_whole(raw)
    return F.when(margin >= 0, margin)


def is_annotated(raw: Column) -> Column:
    return F.coalesce(as_whole(raw) < 0, F.lit(False))


def code_label(codes: dict[str, str], code: Column) -> Column:
    """Decode with a literal map: no join, however many columns share the list."""
    return F.try_element_at(literal_map(codes), code)


def same_length_state(raw: Column) -> tuple[Column, Column]:
    """(two-letter code or NULL, whether a present code was malformed)."""
    return (
        F.when(F.length(raw) == 2, raw),
        F.coalesce(F.length(raw) != 2, F.lit(False)),
    )


def zip_mask_kind(raw: Column) -> Column:
    """How much of a ZIP the publisher left readable."""
    return (
        F.when(raw.isNull(), "null")
        .when(raw.rlike("^[0-9]{5}$"), "full")
        .when(raw.rlike("^[0-9]{3}XX$"), "prefix_masked")
        .when(raw.rlike("^X+$"), "fully_masked")
        .otherwise("malformed")
    )


def zip5(raw: Column) -> Column:
    return F.when(raw.rlike("^[0-9]{5}$"), raw)


def zip3(raw: Column) -> Column:
    return F.when(raw.rlike("^[0-9]{3}"), F.substring(raw, 1, 3))


def first_key(*candidates: tuple[str, Column]) -> tuple[Column, Column]:
    """(first non-NULL candidate, the name of the column that supplied it)."""
    key = F.coalesce(*[c for _, c in candidates])
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in candidates])
    return key, source


def geoid_county(geoid: Column) -> Column:
    return F.nullif(F.substring(geoid, 1, 5), F.lit(""))
