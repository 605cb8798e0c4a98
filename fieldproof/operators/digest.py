"""Equality, containment and difference of two tables as multisets of rows, without joining them.

A row's name is 128 bits of hash over its columns in a stated order, nulls apart from empty texts. A table's digest is
the count of its rows and the sums of both halves of their names, so it doesn't depend on order or partitions, and the
digests of parts add up to that of the whole. Two tables are compared by their digests in 2**bits ranges of names: a
scan each, and a row per range. Only ranges whose digests part are looked into: their rows are counted under their names
with +1 and -1, and what doesn't cancel out is the difference. Equal tables cost two scans and no shuffle of rows.

Digests are kept beside a version (:func:`digests` gives a table), so a later version is compared without reading the
earlier one again, unless ranges part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE_BITS = 12


def _named(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, row): the two halves of each row's name, and the row."""
    every: list[Column] = []
    for c in columns:
        # Spark's hash passes over nulls, so what is null is hashed too
        every += [F.col(f"`{c}`"), F.col(f"`{c}`").isNull()]
    return rows.select(F.xxhash64(F.lit(1), *every).alias("a"), F.xxhash64(F.lit(2), *reversed(every)).alias("b"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))


def _range(bits: int) -> Column:
    return F.shiftrightunsigned("a", 64 - bits) if bits else F.lit(0).cast("long")


def digests(rows: DataFrame, columns: Sequence[str] | None = None, bits: int = RANGE_BITS) -> DataFrame:
    """(range, n, a, b) of the ranges that hold rows: exact sums in decimals, mergeable by adding up."""
    named = _named(rows, columns or rows.columns)
    return named.groupBy(_range(bits).alias("range")).agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("decimal(19, 0)")).alias(c) for c in ("a", "b")])


def merged(*parts: DataFrame) -> DataFrame:
    """The digests of the union (all rows) of what the parts are digests of."""
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return every.groupBy("range").agg(*[F.sum(c).cast(kind).alias(c) for c, kind in (("n", "long"), ("a", "decimal(29, 0)"), ("b", "decimal(29, 0)"))])


def parted(left: DataFrame, right: DataFrame) -> DataFrame:
    """The ranges in which two tables of digests differ; at most 2**bits rows."""
    wide = lambda x, sign: x.select("range", *[(sign * F.col(c).cast("decimal(30, 0)")).alias(c) for c in ("n", "a", "b")])
    return wide(left, 1).unionByName(wide(right, -1)).groupBy("range").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b")]).where("n != 0 or a != 0 or b != 0").select("range")


def equal(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None) -> bool:
    """Whether two tables hold the same rows, each as often. Two scans, a row each."""
    columns = columns or left.columns
    return parted(digests(left, columns, 0), digests(right, columns, 0)).isEmpty()


def difference(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None, bits: int = RANGE_BITS, left_digests: DataFrame | None = None) -> DataFrame:
    """(columns, n): rows that the left table holds n times more than the right one; n is below 0 where it is the other.

    ``left_digests`` are kept ones of the left table over the same columns and bits. Nulls equal nulls. Rows that stand
    equally often in both have no row here; tables without a row are compared like others.
    """
    columns = list(columns or left.columns)
    ranges = parted(digests(left, columns, bits) if left_digests is None else left_digests, digests(right, columns, bits))
    signed = []
    for rows, sign in ((left, 1), (right, -1)):
        named = _named(rows, columns).withColumn("range", _range(bits))
        # at most 2**bits ranges of eight bytes
        signed.append(named.join(F.broadcast(ranges), "range", "left_semi").groupBy("a", "b", "row").agg(F.sum(F.lit(sign)).alias("n")))
    both = signed[0].unionByName(signed[1]).groupBy("a", "b", "row").agg(F.sum("n").alias("n")).where("n != 0")
    return both.select(*[F.col("row").getField(c).alias(c) for c in columns], "n")


def contains(whole: DataFrame, part: DataFrame, columns: Sequence[str] | None = None, bits: int = RANGE_BITS) -> bool:
    """Whether each row of ``part`` stands in ``whole`` at least as often."""
    return difference(whole, part, list(columns or part.columns), bits).where("n < 0").isEmpty()
