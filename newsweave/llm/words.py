"""Column expressions on words of whole texts, shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, gap: str = SPACE_RUN) -> Column:
    """The words between runs of ``gap``; an empty or null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def count_words(text: Column, gap: str = SPACE_RUN) -> Column:
    """``size(split_words(text, gap))`` without a copy of the words: only the first and last part can be empty."""

    def inner(parts: Column) -> Column:
        outside = (parts[0] == "").cast("int") + (F.element_at(parts, -1) == "").cast("int")
        return F.greatest(F.size(parts) - outside, F.lit(0))

    return bind(F.split(F.coalesce(text, F.lit("")), gap), inner)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside lambda functions."""
    return F.transform(F.array(value), body)[0]


def unused_names(df: DataFrame, *stems: str) -> list[str]:
    """One column name for each stem that ``df`` does not have (Spark compares names without regard to case)."""
    taken, names = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = f"own_{stem.lower()}"
        while name in taken:
            name += "_"
        taken.add(name)
        names.append(name)
    return names
