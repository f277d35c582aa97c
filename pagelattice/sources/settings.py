"""Settings as JSON strings, length-prefixed path messages, and names of stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "Width int, Height int, IsMaximised boolean, PaneSize int, Debug struct<Render:boolean,Layout:boolean,Fps:boolean,DirtyRects:boolean>"
#: Defaults, which also stand for sizes that are not positive and for strings that can't be read.
DEFAULTS = {"Width": 1000, "Height": 500, "PaneSize": 350}


def parse(df: DataFrame, column: str) -> DataFrame:
    """df with width, height, is_maximised, pane_size, debug, reset (the string could not be read)."""
    s = F.from_json(column, SCHEMA, {"mode": "PERMISSIVE"})
    size = lambda k: F.when(s[k] > 0, s[k]).otherwise(DEFAULTS[k])
    bad = F.get_json_object(column, "$").isNull()
    return df.select("*", size("Width").alias("width"), size("Height").alias("height"), F.coalesce(s["IsMaximised"], F.lit(False)).alias("is_maximised"), size("PaneSize").alias("pane_size"), s["Debug"].alias("debug"), bad.alias("reset"))


def to_json(df: DataFrame) -> DataFrame:
    """json: settings rows as strings."""
    return df.select(F.to_json(F.struct(F.col("width").alias("Width"), F.col("height").alias("Height"), F.col("is_maximised").alias("IsMaximised"), F.col("pane_size").alias("PaneSize"), F.col("debug").alias("Debug"))).alias("json"))


def properties(df: DataFrame, column: str) -> DataFrame:
    """df with a map column's null values left out."""
    return df.withColumn(column, F.map_filter(column, lambda _, v: v.isNotNull()))


def distinct_names(df: DataFrame, name: str) -> DataFrame:
    """df with `stored`: a name that is taken becomes name.N.ext with the least N from 1 that is free, in order of `ord`.

    A row takes its own name if it is the first to have it; the others of a name count on past the numbers that rows bear as their names."""
    from pyspark.sql import Window as W

    dot = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    stem = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1)
    used = df.select(F.col(name).alias("_n")).distinct()
    # names of the form stem.N.ext that rows bear already, by the name that they stand in the way of
    tail = F.regexp_extract("_n", r"^(.*)\.([0-9]{1,9})(\.[^.]*)?$", 2)
    whole = F.concat(F.regexp_extract("_n", r"^(.*)\.([0-9]{1,9})(\.[^.]*)?$", 1), F.regexp_extract("_n", r"^(.*)\.([0-9]{1,9})(\.[^.]*)?$", 3))
    taken = used.where((tail != "") & ~tail.startswith("0")).select(whole.alias(name), tail.cast("int").alias("k")).groupBy(name).agg(F.array_sort(F.collect_set("k")).alias("_taken"))
    k = (F.row_number().over(W.partitionBy(name).orderBy("ord")) - 1).cast("int")
    # the k-th number that is not taken: each taken one that is not past it moves it on
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), F.col("_k"), lambda a, t: F.when(t <= a, a + 1).otherwise(a))
    out = df.withColumn("_k", k).join(taken, name, "left")
    return out.select(*(F.col(c) for c in df.columns), F.when(F.col("_k") == 0, F.col(name)).otherwise(F.concat(stem, F.lit("."), free.cast("string"), dot)).alias("stored"))


#: Kinds of messages.
FILE_PATH, COMMAND = 1, 2


def frames(df: DataFrame, column: str, key: bytes) -> DataFrame:
    """df with `kind` and `path` of messages: two bytes of length (low byte first), the key phrase, a byte that tells the kind, and a path in
    UTF-8 of that length or a command of one byte (`command`). Messages that are short, of length 0, of another key or kind go."""
    b, n = F.col(column), len(key)
    number = lambda at: F.conv(F.hex(F.substr(b, F.lit(at), F.lit(1))), 16, 10).cast("int")
    size, kind = number(1) + 256 * number(2), number(3 + n)
    body = F.substr(b, F.lit(4 + n), F.when(kind == COMMAND, F.lit(1)).otherwise(size))
    good = (size > 0) & (F.substr(b, F.lit(3), F.lit(n)) == F.lit(key)) & kind.isin(FILE_PATH, COMMAND) & (F.octet_length(body) == F.when(kind == COMMAND, 1).otherwise(size))
    path = F.when(kind == FILE_PATH, F.decode(body, "UTF-8"))
    return df.where(good).withColumns({"kind": kind, "path": path, "command": F.when(kind == COMMAND, number(4 + n))})
