"""What the operators of this subpackage share: Arrow batches, samples, folds, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.tables import drop, look_up, save, shared_folder

__all__ = ["components", "drop", "fold_of", "free_name", "look_up", "sampled", "save", "shared_folder", "small_batches"]

#: Edges of a graph that one task may hold (16 bytes each).
ONE_TASK = 200_000


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by bytes, so that long texts don't meet in one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def sampled(hashed: Column, wanted: Column | float, of: Column | int) -> Column:
    """Whether a row with this 64-bit hash is in a sample of about ``wanted`` of ``of`` rows; holds at any number of rows."""
    share = (F.shiftrightunsigned(hashed, 1) / F.lit(float(1 << 63))).cast("double")
    return share * of < wanted


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df lacks, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), a and b not null: (id, component), component the smallest id.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until nothing changes, which
    takes about the logarithm of the longest path. Each step is a grouped minimum and a join back
    on ids, of which hot ones are split; each is written, so that a lost executor costs one step,
    and the table before it goes. A graph of at most ``ONE_TASK`` edges takes the same steps in one
    partition, without shuffles.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    old = [e := save(e)]
    small = e.count() <= ONE_TASK
    near = (lambda df: df) if small else (lambda df: df.hint("merge"))

    def keep(df: DataFrame) -> DataFrame:
        if small:
            return df.coalesce(1)
        old.append(df := save(df))
        return df

    e = e.coalesce(1) if small else e
    before = None
    while True:
        # large star: neighbours above u go to the least of u and its neighbours
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = both.coalesce(1) if small else both
        least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = keep(both.filter("v > u").join(near(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: u and its neighbours below go to the least of them
        least = keep(large.groupBy("u").agg(F.min("v").alias("m")))
        lower = large.join(near(least), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = lower.union(least.select("u", F.col("m").alias("v")))
        e = save((e.coalesce(1) if small else e).distinct())
        drop(*old)
        old = [e]
        e = e.coalesce(1) if small else e
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = now
