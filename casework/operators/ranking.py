"""First rows of groups: every dedupe, cap and top-k of the library goes through these two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casework.tables import look_up, save


def first_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    """One row of each group of equal keys, the first in order (nulls group together)."""
    return top_by(df, keys, order, 1).drop("rank")


def top_by(df: DataFrame, keys: list, order: list, k: int) -> DataFrame:
    """The first k rows of each group with their ``rank``; Spark cuts groups before it shuffles them."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def ranked(df: DataFrame, keys: list, order: list) -> DataFrame:
    """All rows with their ``rank`` in each group; for groups of a bounded size (see ``ranked_whole``)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def ranked_whole(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """All rows with their ``rank`` in each group, however large a group is.

    Rows are dealt by ranges of (keys, order), so that a group of any size is many tasks; each range
    ranks its own rows, and the counts of the ranges before it in the group are added. order must
    have no ties inside a group. A null key is a group of its own.
    """
    rows = save(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))  # written: ranges are drawn anew by each reader
    own = Window.partitionBy("_range", *keys).orderBy(*order)
    counts = rows.groupBy("_range", *keys).agg(F.count("*").alias("_n"))  # a row for each group and range that has some of it
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_range", *[F.col(k).alias(f"_{k}") for k in keys], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    placed = rows.withColumn("_rank", F.row_number().over(own)).join(counts.withColumnRenamed("_range", "_of"), (F.col("_range") == F.col("_of")) & same)
    return placed.select(*df.columns, (F.col("_rank") + F.col("_before")).cast("int").alias("rank"))


def name_key(c: Column | str) -> Column:
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def case_of(default, *rules: tuple) -> Column:
    """An ordered rule list [(predicate, value), ...] as one column; the first that holds wins."""
    out = None
    for predicate, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(predicate, value) if out is None else out.when(predicate, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return default if out is None else out.otherwise(default)


def holding(texts: DataFrame, names: DataFrame, text: str, name: str, keys: list[str], letters: int = 6) -> DataFrame:
    """Pairs of texts and names of equal keys where the text has the name in it; an empty name is in none.

    Both sides meet on the keys and the name's first letters (all of a shorter one), so that no text
    meets all names of its keys. The names, once counted, are broadcast if they are few.
    """
    named = save(names.filter(F.length(name) > 0).withColumn("_gram", F.substring(name, 1, letters)))
    sizes = [r[0] for r in named.select(F.length("_gram")).distinct().collect()]  # at most ``letters`` numbers
    none = F.array().cast("array<string>")

    def pieces(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(F.col(text), i, F.lit(n)))
        return F.when(F.length(text) >= n, every).otherwise(none)

    grams = F.array_distinct(F.concat(none, *map(pieces, sizes)))
    return look_up(texts.withColumn("_gram", F.explode(grams)), named, [*keys, "_gram"], "inner").drop("_gram").filter(F.contains(F.col(text), F.col(name)))
