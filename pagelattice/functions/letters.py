"""Column functions over the letters of a word: their widths, places along the word's box, and what stands under a point.

A word has `widths` (array of double) and a box; a letter's place is the running sum of widths, so boxes of single letters need
not be kept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G


def positions(widths: Column) -> Column:
    """Where each letter ends along its word: the running sums of widths."""
    start = F.array().cast("array<double>")
    return F.aggregate(widths, start, lambda a, w: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + w)))


def width_ratio(widths: Column, left: Column, right: Column) -> Column:
    """Sum of widths over the box's width; null for a box without width."""
    return F.aggregate(widths, F.lit(0.0), lambda a, w: a + w) / F.nullif(right - left, F.lit(0.0))


def ratio_is_good(ratio: Column) -> Column:
    return ratio.between(0.8, 1.2)


def mean_rotation(rotations: Column) -> Column:
    """Mean of an array of angles; null for none, and for one that is not a number."""
    n = F.size(rotations)
    mean = F.aggregate(rotations, F.lit(0.0), lambda a, r: a + r) / F.nullif(n, F.lit(0))
    return F.when(~F.isnan(mean), mean)


def letter_under(x: Column, y: Column, ends: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """The letter (from 0) under a point of a level word, -1 outside its box or for a word without letters."""
    inside = G.in_box(x, y, left, top, right, bottom)
    s = G.projection(x, y, left, bottom, right, bottom)
    first = F.array_position(F.transform(ends, lambda e: s <= e / (right - left)), True).cast("int") - 1
    return F.when(~inside | (F.size(ends) == 0), -1).when(first < 0, F.size(ends) - 1).otherwise(F.coalesce(first, F.lit(-1)))


def letter_nearest(x: Column, ends: Column, left: Column) -> Column:
    """The letter of a level word whose middle is nearest to x, the first of equals; -1 for a word without letters."""
    off = F.transform(ends, lambda e, i: F.struct(F.abs(x - left - (e + F.when(i == 0, F.lit(0.0)).otherwise(F.get(ends, i - 1))) / 2).alias("d"), i.alias("i")))
    return F.coalesce(F.array_min(off)["i"], F.lit(-1))


def letter_at(x: Column, y: Column, ends: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """The letter under a point, else the nearest one, -1 for a word without letters."""
    under = letter_under(x, y, ends, left, top, right, bottom)
    return F.when(under >= 0, under).otherwise(letter_nearest(x, ends, left))


def letter_offset(x: Column, letter: Column, ends: Column, left: Column) -> Column:
    """How far into a letter a point is, in the units of the box: 0 at its begin."""
    return x - left - F.when(letter == 0, F.lit(0.0)).otherwise(F.get(ends, letter - 1))


def span(first: Column, last: Column, ends: Column, left: Column, top: Column, bottom: Column) -> Column:
    """The box of letters first to last of a level word."""
    begin = F.when(first == 0, F.lit(0.0)).otherwise(F.get(ends, first - 1))
    return F.struct((left + begin).alias("left"), top.alias("top"), (left + F.get(ends, last)).alias("right"), bottom.alias("bottom"))
