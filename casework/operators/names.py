"""Which name stands for which: first matches among many names, without pairs of all names of a case.

Two keys of one case match if they are equal, if one of four letters or more stands in the other,
or if both have eight letters or more and share 60 % of the words of the one with more (words of
three letters or more). Each rule is a join of its own:

- a key meets the keys that have the rarest of its four-letter pieces;
- word sets of up to ``WORDS`` words meet on the subsets that two sets of their sizes must share,
  of which only the first name of each is kept, so that a phrase that a whole case shares is one
  row and not its square;
- larger word sets meet on their rarest words, as many as no two alike sets can both lack.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.functions.text import normalized_name
from casework.tables import drop, save

#: The share of words, letters of a contained key, letters of keys that are compared by words; the largest sets with subsets.
SHARE, HELD, LONG, WORDS = 0.6, 4, 8, 8
#: Open names of a case that one task may settle by themselves.
ONE_TASK = 2_000


def words(key: Column) -> Column:
    """The distinct words of three letters or more, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(key, r"\s+"), lambda w: F.length(w) > 2)))


def _pieces(key: str) -> Column:
    return F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(key) - (HELD - 1)), lambda i: F.substring(F.col(key), i, F.lit(HELD)))))


def holding(holders: DataFrame, held: DataFrame) -> DataFrame:
    """(case_id, holder, held): keys of tables of distinct (case_id, key) where the first has the second in it."""
    long_ = F.length("key") >= HELD
    pieces = holders.filter(long_).select("case_id", F.col("key").alias("holder"), _pieces("key").alias("piece"))
    count = pieces.groupBy("case_id", "piece").count()
    own = held.filter(long_).select("case_id", F.col("key").alias("held"), _pieces("key").alias("piece"))
    rarest = own.join(count, ["case_id", "piece"], "left").groupBy("case_id", "held").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "piece")).alias("m"))
    rarest = rarest.filter("m.n > 0").select("case_id", "held", "m.piece")  # a piece that no holder has: none holds it
    return rarest.join(pieces, ["case_id", "piece"]).filter(F.contains("holder", "held")).select("case_id", "holder", "held")


def _shared(x: int, y: int) -> int:
    """The least number of words that sets of x and y words must share."""
    return next(k for k in range(1, max(x, y) + 1) if k / max(x, y) >= SHARE)


def _subsets(sizes: list[tuple[int, int, int]]) -> Column:
    """struct(of, part): for a set of x words, its subsets of k words, labelled with y; of the (x, y, k) of its size."""
    w = F.col("words")

    def of(y: int, k: int) -> Column:
        masks = F.filter(F.sequence(F.lit(1), F.shiftleft(F.lit(1), WORDS) - 1), lambda m: (F.bit_count(m) == k) & (m < F.expr("shiftleft(1, size(words))")))
        return F.transform(masks, lambda m: F.struct(F.lit(y).alias("of"), F.array_join(F.filter(w, lambda x, i: F.getbit(m.cast("long"), i) == 1), " ").alias("part")))

    out = F.array().cast("array<struct<of:int,part:string>>")
    for x in range(1, WORDS + 1):
        parts = [of(y, k) for s, y, k in sizes if s == x]
        out = F.when(F.size(w) == x, F.concat(*parts)).otherwise(out)
    return out


def _by_subset(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(case_id, words, at): the first name that shares enough words with each set; both (case_id, words[, at])."""
    every = [(x, y, _shared(x, y)) for x in range(1, WORDS + 1) for y in range(1, WORDS + 1) if _shared(x, y) <= min(x, y)]
    stored = known.select("case_id", "at", F.explode(_subsets(sorted({(y, y, k) for _, y, k in every}))).alias("s")).groupBy("case_id", F.col("s.of").alias("of"), F.col("s.part").alias("part")).agg(F.min("at").alias("at"))
    look = asked.select("case_id", "words", F.explode(_subsets(every)).alias("s")).select("case_id", "words", "s.of", "s.part")
    return look.join(stored, ["case_id", "of", "part"]).select("case_id", "words", "at")


def _by_rarest(asked: DataFrame, known: DataFrame) -> DataFrame:
    """The same for pairs of which one set has more than ``WORDS`` words."""
    least = F.size("words") >= _shared(1, WORDS + 1)
    a, b = asked.filter(least), known.filter(least)
    count = a.select("case_id", "words").union(b.select("case_id", "words")).distinct().select("case_id", F.explode("words").alias("word")).groupBy("case_id", "word").count()

    def prefixes(df: DataFrame, name: str) -> DataFrame:
        ordered = df.select("case_id", "words", F.explode("words").alias("word")).distinct().join(count, ["case_id", "word"]).groupBy("case_id", "words").agg(F.array_sort(F.collect_list(F.struct("count", "word"))).alias("o"))
        n = F.size("o") - F.ceil(F.size("o") * SHARE - 1e-9).cast("int") + 1
        return ordered.select("case_id", F.col("words").alias(name), F.explode(F.slice("o", F.lit(1), n)).alias("o")).select("case_id", name, "o.word")

    met = prefixes(a, "x").join(prefixes(b, "y"), ["case_id", "word"]).select("case_id", "x", "y").distinct()
    most = F.greatest(F.size("x"), F.size("y"))
    met = met.filter((most > WORDS) & (F.size(F.array_intersect("x", "y")) / most >= SHARE))
    return met.join(b.withColumnRenamed("words", "y"), ["case_id", "y"]).select("case_id", F.col("x").alias("words"), "at")


def first_match(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(case_id, key, at): for each key of asked, the least ``at`` of the keys of known that match it; none where none does.

    asked: distinct (case_id, key). known: distinct (case_id, key, at), written tables both. at is any type that has an order.
    """
    asked, keys = asked.select("case_id", "key"), known.select("case_id", "key")
    at_of = lambda pairs, name: pairs.join(known.withColumnRenamed("key", name), ["case_id", name])
    exact = asked.join(known, ["case_id", "key"])
    above = at_of(holding(keys, asked), "holder").select("case_id", F.col("held").alias("key"), "at")
    below = at_of(holding(asked, keys), "held").select("case_id", F.col("holder").alias("key"), "at")
    worded = lambda df: df.filter(F.length("key") >= LONG).withColumn("words", words(F.col("key"))).filter(F.size("words") > 0)
    sets = worded(asked)
    a, k = sets.select("case_id", "words").distinct(), worded(known).groupBy("case_id", "words").agg(F.min("at").alias("at"))
    alike = _by_subset(a, k).union(_by_rarest(a, k)).groupBy("case_id", "words").agg(F.min("at").alias("at"))
    alike = sets.join(alike, ["case_id", "words"]).select("case_id", "key", "at")
    every = exact.select("case_id", "key", "at").union(above).union(below).union(alike)
    return every.groupBy("case_id", "key").agg(F.min("at").alias("at"))


def resolved(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates (case_id, name) with the existing name (case_id, name, id) each stands for, the first by id; null if none.

    Null names stand for nothing; ties of the id go to the smaller name; an empty table of either gives no match.
    """
    c = save(candidates.select("case_id", F.col("name").alias("candidate")).distinct().withColumn("key", normalized_name(F.col("candidate"))))
    e = existing.filter("name is not null").select("case_id", normalized_name(F.col("name")).alias("key"), F.struct("id", "name").alias("at")).groupBy("case_id", "key").agg(F.min("at").alias("at"))
    e = save(e)
    found = first_match(c.filter("key is not null").select("case_id", "key").distinct(), e)
    return c.join(found, ["case_id", "key"], "left").select("case_id", "candidate", F.col("at.name").alias("canonical"))


def canonical(names: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(case_id, name, place, final_name): each name resolved against the final names of those before it in its case.

    names: (case_id, name, place), place a whole number without ties inside a case, name not null. A
    case with few open names is settled in one pass over them. In a larger one a name without a match
    before it is final, and one whose first match is final takes it; the others wait for a round, in
    which names that have taken another no longer count. Each round settles at least the first open
    name of a case. Both ways give the same names.
    """
    named = save(names.select("case_id", "name", "place").withColumn("key", normalized_name(F.col("name"))))
    live = named.groupBy("case_id", "key").agg(F.min("place").alias("at")).withColumn("final", F.lit(False))
    settled, old = [], []
    while True:
        size = live.groupBy("case_id").agg(F.count_if(~F.col("final")).alias("open")).filter("open > 0")
        live = save(live.join(size, "case_id"))
        old.append(live)
        few = live.filter(F.col("open") <= one_task)
        settled.append(_one_pass(few, len(old) > 1))
        live = live.filter(F.col("open") > one_task).drop("open")
        if live.isEmpty():
            break
        open_ = live.filter(~F.col("final"))
        found = open_.join(first_match(open_, live.select("case_id", "key", "at")).withColumnRenamed("at", "first"), ["case_id", "key"])
        heads = save(found.filter("first = at").select("case_id", "key", "at", F.lit(True).alias("final")).union(live.filter("final")))
        mark = heads.select("case_id", F.col("at").alias("first"), F.lit(True).alias("taken"))
        found = save(found.filter("first < at").join(mark, ["case_id", "first"], "left"))
        settled.append(found.filter("taken").select("case_id", "key", F.col("first").alias("to")))
        live = heads.union(found.filter("taken is null").select("case_id", "key", "at", F.lit(False)))
        old += [heads, found]
    every = settled[0]
    for s in settled[1:]:
        every = every.union(s)
    to = named.groupBy("case_id", "key").agg(F.min("place").alias("at")).join(every, ["case_id", "key"], "left").select("case_id", "key", F.coalesce("to", "at").alias("to"))
    other = named.select("case_id", F.col("place").alias("to"), F.col("name").alias("final_name"))
    out = save(named.join(to, ["case_id", "key"]).join(other, ["case_id", "to"]).select("case_id", "name", "place", "final_name"))
    drop(named, *old)
    return out


def _one_pass(live: DataFrame, some_final: bool) -> DataFrame:
    """(case_id, key, to) of the open keys of cases with few of them that take another: the first final match, or an open one before it."""
    rows = live.filter(~F.col("final")).select("case_id", "key", "at")
    if some_final:
        first = first_match(rows, live.filter("final").select("case_id", "key", "at"))
        rows = rows.join(first.withColumnRenamed("at", "final_at"), ["case_id", "key"], "left")
    else:
        rows = rows.withColumn("final_at", F.lit(None).cast(live.schema["at"].dataType))

    def settle(g: pd.DataFrame) -> pd.DataFrame:
        heads, taken = [], []
        for key, at, final in sorted(zip(g["key"], g["at"], g["final_at"], strict=True), key=lambda x: x[1]):
            own = frozenset(w for w in key.split() if len(w) > 2)
            to = min([a for a in (final,) if a < at] + [next((a for a, k, w in heads if _match(key, own, k, w)), at)])
            if to == at:
                heads.append((at, key, own))
            else:
                taken.append((g.case_id.iloc[0], key, int(to)))
        return pd.DataFrame(taken, columns=["case_id", "key", "to"])

    of = live.schema
    return rows.groupBy("case_id").applyInPandas(settle, f"case_id {of['case_id'].dataType.simpleString()}, key string, to {of['at'].dataType.simpleString()}")


def _match(a: str, of_a: frozenset, b: str, of_b: frozenset) -> bool:
    if a == b or min(len(a), len(b)) >= HELD and (a in b or b in a):
        return True
    return min(len(a), len(b)) >= LONG and bool(of_a and of_b) and len(of_a & of_b) / max(len(of_a), len(of_b)) >= SHARE
