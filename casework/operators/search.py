"""Names and titles that have given words in them, by an index of letter groups that is written once.

The index has a row for each different group of one to three letters of each text. A query meets
the rows of its rarest group alone, and what it finds is verified against the whole text. A written
index is laid out by a hash of the group, so that a look-up reads the files of its own groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.operators.dossier import registry
from casework.operators.ranking import ranked_whole
from casework.tables import look_up, save

#: Letters of a group; folders of a written index.
LETTERS, FOLDERS = 3, 256


def groups(low: Column, n: int) -> Column:
    """All different groups of n letters of a text."""
    every = F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substring(low, i, F.lit(n)))
    return F.when(F.length(low) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def folder_of(group: Column) -> Column:
    return F.pmod(F.xxhash64(group), F.lit(FOLDERS)).cast("int")


def indexed(rows: DataFrame, text: str) -> DataFrame:
    """(gram, folder, id, low) of rows (id, text); null and empty texts have no rows."""
    low = rows.select("id", F.lower(text).alias("low"))
    every = low.select("id", "low", F.explode(F.concat(*[groups(F.col("low"), n) for n in range(1, LETTERS + 1)])).alias("gram"))
    return every.select("gram", folder_of(F.col("gram")).alias("folder"), "id", "low")


def write_index(rows: DataFrame, text: str, path: str) -> None:
    """Writes the index of rows (id, text) below path, a folder for each share of the groups, sorted by group."""
    index = indexed(rows, text)
    index.repartition("folder", "gram").sortWithinPartitions("folder", "gram").write.mode("overwrite").partitionBy("folder").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def found(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id, low) for each row of the index whose text has the query in it, whatever the case.

    queries: (query), a table of any size; each different one counts once, null and empty ones find
    nothing. A group that the index lacks ends its query.
    """
    asked = save(queries.select("query", F.lower("query").alias("asked")).filter("asked <> ''").distinct())
    size = F.least(F.length("asked"), F.lit(LETTERS))
    own = F.coalesce(*[F.when(size == n, groups(F.col("asked"), n)) for n in range(1, LETTERS + 1)])
    wanted = save(asked.select("query", "asked", F.explode(own).alias("gram")).withColumn("folder", folder_of(F.col("gram"))))
    # the folders of the queries' groups, at most FOLDERS numbers, prune a written index
    folders = [r.folder for r in wanted.select("folder").distinct().collect()]
    near = index.filter(F.col("folder").isin(folders))
    # the queries' side is written and counted: Spark would broadcast the index by the size of the files it is made of
    count = save(look_up(near, save(wanted.select("folder", "gram").distinct()), ["folder", "gram"], "left_semi").groupBy("folder", "gram").count())
    rarest = look_up(wanted, count, ["folder", "gram"]).groupBy("query", "asked").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "folder", "gram")).alias("m")).filter("m.n > 0")
    rarest = save(rarest.select("query", "asked", "m.folder", "m.gram"))
    return look_up(near, rarest, ["folder", "gram"], "inner").filter(F.contains("low", "asked")).select("query", "id", "low")


def registry_search(entities: DataFrame, mentions: DataFrame, queries: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(query, rank, id, case_id, name, type, n_mentions, n_documents): entities whose name has the query in it, the most mentioned first.

    index: that of the entities' names, if there is a written one.
    """
    hits = found(indexed(entities, "name") if index is None else index, queries).select("query", "id")
    rows = hits.join(registry(entities, mentions), "id")
    out = ranked_whole(rows, ["query"], [F.desc("n_mentions"), "id"])
    return out.select("query", "rank", "id", "case_id", "name", "type", "n_mentions", "n_documents")


def title_search(documents: DataFrame, queries: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(query, id, case_id, title) of documents whose title has the query in it."""
    hits = found(indexed(documents, "title") if index is None else index, queries).select("query", "id")
    # merged: Spark would broadcast the documents by the size of their files, of which titles may be many times as large
    return hits.join(documents.select("id", "case_id", "title").hint("merge"), "id").select("query", "id", "case_id", "title")
