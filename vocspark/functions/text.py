"""Expressions over free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_text(col: str | Column) -> Column:
    """True when the text is present and not only spaces (other whitespace counts as text)."""
    c = _c(col)
    return c.isNotNull() & (F.trim(c) != "")


def full_text(title: str | Column, body: str | Column, skip_empty_title: bool = False) -> Column:
    """Title and body joined by ". ".

    A missing title leaves the leading ". " in place unless `skip_empty_title`.
    """
    head = _c(title)
    if skip_empty_title:
        head = F.when(F.trim(head) != "", head)  # concat_ws leaves nulls out
    else:
        head = F.coalesce(head, F.lit(""))
    return F.trim(F.concat_ws(". ", head, _c(body)))


def tokens(col: str | Column) -> Column:
    """Lower-case runs of letters, in order, with repetition."""
    return F.array_remove(F.split(F.lower(F.coalesce(_c(col), F.lit(""))), r"\P{L}++"), "")


def strip_whitespace(col: Column) -> Column:
    """Drop leading and trailing whitespace of any kind, not only spaces."""
    return F.regexp_replace(col, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col
