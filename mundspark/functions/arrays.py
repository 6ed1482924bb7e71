"""Sequences of token ids: bounds, padding, shifted and masked targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Target that a loss passes over.
IGNORE = -100


def bounded(ids: Column, begin: int, end: int, most: int) -> Column:
    """ids with a begin and an end mark, cut to at most `most` including both."""
    return F.concat(F.array(F.lit(begin)), F.slice(ids, 1, most - 2), F.array(F.lit(end)))


def inside(ids: Column, begin: int, end: int) -> Column:
    """The ids after the first begin mark and before the first end mark; a mark that is absent bounds nothing."""
    b = F.array_position(ids, begin)
    rest = F.slice(ids, b.cast("int") + 1, F.greatest(F.size(ids), F.lit(1)))
    e = F.array_position(rest, end).cast("int")
    return F.slice(rest, 1, F.when(e > 0, e - 1).otherwise(F.size(rest)))


def padded(ids: Column, length: Column | int, pad: int = 0) -> Column:
    """ids cut or padded at the right to a length."""
    n = F.lit(length) if isinstance(length, int) else length
    return F.concat(F.slice(ids, 1, n), F.array_repeat(F.lit(pad), F.greatest(n - F.size(ids), F.lit(0)).cast("int")))


def targets(ids: Column, length: Column | int, skip: Column | int = 0, ignore: int = IGNORE) -> Column:
    """What each place of a padded row is to predict: the id after it; ignored in the first `skip` places, at the last id
    and in the padding."""
    n = F.lit(length) if isinstance(length, int) else length
    s = F.lit(skip) if isinstance(skip, int) else skip
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when((i >= s) & (i + 1 < F.size(ids)), F.get(ids, i + 1)).otherwise(F.lit(ignore)))
