"""Lookups by place: what is under a point, what is nearest, which page or element a view shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

KEYS = ["doc_id", "page_no"]


def under(points: DataFrame, boxes: DataFrame, idx: str) -> DataFrame:
    """points (doc_id, page_no, x, y) with the first box of its page, by idx, that holds it; borders count. Points that hit nothing
    go. min_by keeps one row a point: no sort of all pairs."""
    inside = G.in_box(F.col("p.x"), F.col("p.y"), F.col("b.left"), F.col("b.top"), F.col("b.right"), F.col("b.bottom"))
    both = points.alias("p").join(boxes.alias("b"), [*(F.col(f"p.{k}") == F.col(f"b.{k}") for k in KEYS), inside])
    return both.groupBy("p.doc_id", "p.page_no", "p.x", "p.y").agg(F.min(f"b.{idx}").alias(idx))


def nearest_line(points: DataFrame, lines: DataFrame, y_weight: float = 4.0) -> DataFrame:
    """points with the nearest line of its page while selecting, by projection on the line's base (left to right bottom corner).

    Lines that the point falls before don't count; past a line's end its right corner counts and the last word is meant; heights weigh
    four times."""
    x, y, a, b, c = F.col("p.x"), F.col("p.y"), F.col("l.left"), F.col("l.right"), F.col("l.bottom")
    s = G.projection(x, y, a, c, b, c)
    nx = F.when(s > 1, b).otherwise(a + s * (b - a))
    both = points.alias("p").join(lines.alias("l"), [F.col(f"p.{k}") == F.col(f"l.{k}") for k in KEYS]).where(s >= 0)
    best = F.min(F.struct(G.euclidean(x, y, nx, c, 1.0, y_weight).alias("dist"), F.col("l.line_idx").alias("line_idx"), (s >= 1).alias("past_end"))).alias("m")
    return both.groupBy("p.doc_id", "p.page_no", "p.x", "p.y").agg(best).select("doc_id", "page_no", "x", "y", "m.line_idx", "m.dist", "m.past_end")


def nearest_line_in_row(paged: DataFrame, y_weight: float = 4.0) -> DataFrame:
    """nearest_line() of pages (doc_id, page_no, x, y, lines: array of line_idx and box), without a shuffle. Pages whose point falls before
    all lines go."""

    def near(a):
        s = G.projection(F.col("x"), F.col("y"), a["left"], a["bottom"], a["right"], a["bottom"])
        nx = F.when(s > 1, a["right"]).otherwise(a["left"] + s * (a["right"] - a["left"]))
        return F.when(s >= 0, F.struct(G.euclidean(F.col("x"), F.col("y"), nx, a["bottom"], 1.0, y_weight).alias("dist"), a["line_idx"].alias("line_idx"), (s >= 1).alias("past_end")))

    best = paged.withColumn("m", F.array_min(F.transform("lines", near))).where("m is not null")
    return best.select("doc_id", "page_no", "x", "y", "m.line_idx", "m.dist", "m.past_end")


def under_in_row(paged: DataFrame, boxes: str = "words") -> DataFrame:
    """under() of pages (doc_id, page_no, x, y, boxes: array with box), without a shuffle: `idx` is the place of the first box that holds the point."""
    hit = F.transform(boxes, lambda b: G.in_box(F.col("x"), F.col("y"), b["left"], b["top"], b["right"], b["bottom"]))
    return paged.select("doc_id", "page_no", "x", "y", (F.array_position(hit, True) - 1).cast("int").alias("idx")).where("idx >= 0")


def nearest_word(points: DataFrame, words: DataFrame) -> DataFrame:
    """points (with line_idx) with the word of that line whose lower left or right corner is nearest."""
    d = lambda c: G.euclidean(F.col("p.x"), F.col("p.y"), F.col(f"w.{c}"), F.col("w.bottom"))
    on = [F.col(f"p.{k}") == F.col(f"w.{k}") for k in (*KEYS, "line_idx")]
    best = F.min(F.struct(F.least(d("left"), d("right")).alias("dist"), F.col("w.word_idx").alias("word_idx"))).alias("m")
    return points.alias("p").join(words.alias("w"), on).groupBy("p.doc_id", "p.page_no", "p.x", "p.y").agg(best).select("doc_id", "page_no", "x", "y", "m.word_idx")


def lines(words: DataFrame) -> DataFrame:
    """Lines of word rows that carry line_idx: box, words, first word, text."""
    return words.groupBy(*KEYS, "line_idx").agg(
        F.min("word_idx").alias("word_start"), F.count(F.lit(1)).alias("n_words"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_idx", "value"))), lambda w: w["value"]), "").alias("joined"),
    )


def lines_in_row(paged: DataFrame) -> DataFrame:
    """lines() of pages (doc_id, page_no, words: array of value, r, the line, and box, in reading order), without a shuffle. Words of a line
    stand together, so a line is a slice, whose begin is where its number is met first."""
    r = F.transform("words", lambda w: w["r"])
    own = paged.select("doc_id", "page_no", "words", r.alias("r")).select("doc_id", "page_no", "words", F.explode(F.array("r")).alias("r"))
    begins = own.select("doc_id", "page_no", "words", F.explode(F.transform(F.array_distinct("r"), lambda k: F.struct(k.alias("k"), F.array_position("r", k).cast("int").alias("at"), F.size(F.filter("r", lambda x: x == k)).alias("n")))).alias("l"))
    sliced = begins.select("doc_id", "page_no", "l", F.explode(F.array(F.slice("words", F.col("l.at"), F.col("l.n")))).alias("w"))
    return sliced.select(
        "doc_id", "page_no", F.col("l.k").alias("line_idx"), (F.col("l.at") - 1).alias("word_start"), F.col("l.n").cast("bigint").alias("n_words"), F.array_min("w.left").alias("left"), F.array_min("w.top").alias("top"),
        F.array_max("w.right").alias("right"), F.array_max("w.bottom").alias("bottom"), F.array_join("w.value", "").alias("joined"),
    )


def in_view(pages: DataFrame, left: float, top: float, right: float, bottom: float) -> DataFrame:
    """Pages (left, top, right, bottom) that a view shows some of, with the shown area."""
    shown = pages.where((F.col("bottom") > top) & (F.col("top") < bottom))
    area = G.overlap_area(F.col("left"), F.col("top"), F.col("right"), F.col("bottom"), *map(F.lit, (left, top, right, bottom)))
    return shown.withColumn("area", area).where("area > 0")


def most_shown(pages: DataFrame, view: tuple) -> DataFrame:
    """Of each document the page with the largest shown area, the first of equals."""
    return in_view(pages, *view).groupBy("doc_id").agg(F.max_by("page_no", F.struct("area", -F.col("page_no"))).alias("page_no"), F.max("area").alias("area"))


def keep_annotations(annotations: DataFrame) -> DataFrame:
    """Annotations with an area that link, act or say something; interactive: a link that acts."""
    acts = F.col("action").isNotNull()
    says = F.col("content").isNotNull() & (F.col("content") != "")
    return annotations.where((F.col("width") > 0) & (F.col("height") > 0) & (F.col("is_link") | acts | says)).withColumn("is_interactive", F.col("is_link") & acts)
