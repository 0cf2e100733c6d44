"""What the operators of this subpackage share: scratch tables, word rules, row helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import saved, scratch_path, shared_dir  # noqa: F401

#: White space of the word rule, as a character class; the same in Java, Python and RE2.
WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space as plain characters.
WS_CHARS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words of the word rule, as an array; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS + "+"), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def packed(carry: list[str]) -> Column:
    """The carried columns as one struct named row, so that no name of theirs can clash inside an operator."""
    return (F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.struct(F.lit(0))).alias("row")


def unpacked(carry: list[str], *own: str) -> list[Column]:
    """The carried columns again, and the operator's own; these replace carried ones of the same name."""
    taken = {c.lower() for c in own}
    return [*(F.col("row")[c].alias(c) for c in carry if c.lower() not in taken), *(F.col(c) for c in own)]


def private(df: DataFrame, *names: str) -> list[str]:
    """Column names starting with these that df doesn't have yet, so that extra input columns can't clash."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
