"""Page text, phrase search with word ordinals and samples, page roll-up, and hits as boxes.

A page's text is its words joined by one space, made within the row; search is a projection over it, so neither shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def page_text(valued: DataFrame) -> DataFrame:
    """The text of pages (doc_id, page_no, values): words joined by one space."""
    return valued.select("doc_id", "page_no", F.array_join("values", " ").alias("text"))


def literal(query: str) -> str:
    """A pattern that means the query itself."""
    return "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def cleaned(query: str) -> tuple[str, int]:
    """A query as the index has it, and its words."""
    import unicodedata

    marks = [unicodedata.category(c)[0] == "P" for c in query]
    out = "".join((" " if m and i else "") + c + (" " if m and i < len(query) - 1 else "") for i, (c, m) in enumerate(zip(query, marks, strict=True)))
    return out, out.count(" ") + 1 - out.startswith(" ") - (out.endswith(" ") and len(out) > 1)


def search(texts: DataFrame, query: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, page_no, word_idx, word_count, char_pos, sample of every hit, and columns of its page to keep; no hit overlaps one before it."""
    q, n = cleaned(query)
    if not q:
        return texts.limit(0).select("doc_id", "page_no", F.lit(0).alias("word_idx"), F.lit(0).alias("word_count"), F.lit(0).alias("char_pos"), F.lit("").alias("sample"), *keep)
    low = q.lower()
    # pieces between hits: a hit stands after the pieces before it and as many queries
    pieces = F.split(F.lower("text"), literal(low), -1)
    sizes = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), F.length)
    ends = F.aggregate(sizes, F.array().cast("array<int>"), lambda a, s: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)) + len(low), F.lit(0)) + s)))
    hits = texts.where(F.lower("text").contains(low)).select("doc_id", "page_no", "text", F.explode(ends).alias("char_pos"), *keep)
    before = F.substr("text", F.lit(1), F.col("char_pos"))
    word = F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))
    return hits.select("doc_id", "page_no", word.alias("word_idx"), F.lit(n).alias("word_count"), "char_pos", T.sample(F.col("text"), F.col("char_pos")).alias("sample"), *keep)


def by_page(hits: DataFrame) -> DataFrame:
    """A row a page with hits: their number, the first one's word and the page's label."""
    g = hits.groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("n_hits"), F.min("word_idx").alias("first_word"))
    return g.withColumn("label", T.page_label(F.col("page_no"), F.col("n_hits")))


def hit_boxes(hits: DataFrame, words: DataFrame) -> DataFrame:
    """The boxes of the words of each hit: hits are spread over their words, then joined by equality (no range join)."""
    spread = hits.select("doc_id", "page_no", F.col("word_idx").alias("hit"), F.explode(F.sequence(F.col("word_idx"), F.col("word_idx") + F.col("word_count") - 1)).alias("word_idx"))
    return spread.join(words, ["doc_id", "page_no", "word_idx"]).select("doc_id", "page_no", "hit", "word_idx", "left", "top", "right", "bottom")


def boxes_in_row(paged: DataFrame, query: str) -> DataFrame:
    """hit_boxes() of pages (doc_id, page_no, words: array with value and box), without a shuffle: each box is taken by its place."""
    texts = paged.withColumn("text", F.array_join(F.transform("words", lambda w: w["value"]), " "))
    hits = search(texts, query, ("words",))
    spread = hits.select("doc_id", "page_no", F.col("word_idx").alias("hit"), "words", F.explode(F.sequence(F.col("word_idx"), F.col("word_idx") + F.col("word_count") - 1)).alias("word_idx"))
    return spread.withColumn("w", F.get("words", F.col("word_idx"))).select("doc_id", "page_no", "hit", "word_idx", "w.left", "w.top", "w.right", "w.bottom")


def unsearched(pages: DataFrame, hits: DataFrame) -> DataFrame:
    """Pages that have no hit yet."""
    return pages.join(hits.select("doc_id", "page_no").distinct(), ["doc_id", "page_no"], "left_anti")
