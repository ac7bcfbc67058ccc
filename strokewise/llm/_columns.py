"""Small builders of native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space is space and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, and only where body is reached."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def occurrences(text: Column, characters: str) -> Column:
    """How often any of the characters stands in the text."""
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def blocks(array: Column) -> Column:
    """The array in runs of about the square root of its length."""
    n = F.size(array)
    step = F.greatest(F.lit(16), F.ceil(F.sqrt(n)).cast("int"))
    return let(step, lambda b: F.when(n == 0, F.slice(F.array(array), 1, 0)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), b), lambda i: F.slice(array, i, b))))


def running(steps: Column, first: Column) -> Column:
    """array<int>: first, and the sums of it with the steps so far; one more than there are steps."""
    return F.aggregate(steps, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def cumulated(steps: Column) -> Column:
    """array<int>: for each step the sum of those before it.

    Runs of about the square root of the number of steps are added up first, so
    that no long array is copied for each of its elements.
    """

    def placed(parts: Column) -> Column:
        totals = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x))
        each = lambda at: F.zip_with(parts, F.slice(at, 1, F.size(parts)), lambda part, first: F.slice(running(part, first), 1, F.size(part)))
        return F.flatten(let(running(totals, F.lit(0)), each))

    return let(blocks(steps), placed)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,match>> of the leftmost non-overlapping matches, in code points (end exclusive).

    The pieces between the matches give where each stands.
    """
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        pairs = F.zip_with(gaps, found, lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("size"), m.alias("match")))

        def spans(pairs: Column) -> Column:
            before = cumulated(F.transform(pairs, lambda x: x["gap"] + x["size"]))
            return F.zip_with(pairs, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["match"].alias("match")))

        return let(pairs, spans)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, empty).otherwise(placed(found)))
