import math
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from casework.operators.feed import feed_items
from casework.sources.views import load
from casework.streaming import flows, summaries


def test_new_documents_are_analysed_once(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "document_id long, text string"
    given = []

    def extract(df):
        given.append(df.count())
        return df.filter("text <> ''").select("document_id", F.length("text").alias("n"))

    for rows in ([(1, "a"), (2, "bb"), (4, "")], [(2, "bb"), (3, "ccc"), (4, "")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        flows.analyse_on_arrival(spark.readStream.schema(schema).parquet(src), extract, out, f"{tmp_path}/check").awaitTermination()
    assert sorted(map(tuple, flows.found(spark, out).collect())) == [(1, 1), (2, 2), (3, 3)]
    assert sum(given) == 4  # the empty one, too, is taken once


def test_a_failed_batch_runs_again_and_adds_nothing_twice(spark, tmp_path):
    src, out, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"
    schema, fail = "document_id long, text string", [False]

    def extract(df):
        if fail[0] and df.count():
            df.select("document_id").write.mode("append").parquet(f"{tmp_path}/lost")
            raise RuntimeError("lost")
        return df.select("document_id", F.length("text").alias("n"))

    def run():
        return flows.analyse_on_arrival(spark.readStream.schema(schema).parquet(src), extract, out, check)

    states = []
    for i in range(4):
        spark.createDataFrame([(k, "x" * k) for k in range(10 * i + 5)], schema).write.mode("append").parquet(src)
        fail[0] = i == 2
        q = run()
        if fail[0]:
            with pytest.raises(StreamingQueryException):
                q.awaitTermination()
            fail[0] = False
            q = run()
        q.awaitTermination()
        states.append(q.lastProgress["stateOperators"][0])
    assert sorted(map(tuple, flows.found(spark, out).collect())) == [(k, k) for k in range(35)]
    # the state holds every key, of which a batch writes its new ones alone
    assert states[-1]["numRowsTotal"] == 35 and states[-1]["numRowsUpdated"] == 10 and any(x.startswith("rocksdb") for x in states[-1]["customMetrics"])
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != flows.ROCKSDB


def test_kept_summaries_equal_whole_recomputation(spark, tmp_path, sf_dir):
    signals = load(spark, sf_dir, "signals").withColumn("case_id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("case_id")))  # a third in one case
    odd = spark.createDataFrame([(-1, 7, None, None, None, None, None), (-2, None, 1, "x", 5.0, "$5", None), (-3, 900, 1, " X ", 0.1, "$.1", "GRANT"), (-4, 900, 1, "x", 0.2, "$.2", None), (-4, 900, 1, "x", 0.2, "$.2", None), (-5, 900, 2, "y", 1e300, "$1", None), (-6, 900, 2, "y", -1e300, "$1", None)], "id long, case_id long, document_id long, entity_name string, normalized_amount double, amount_display string, signal_type string")
    every = signals.select(odd.columns).union(odd).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(3)))
    src, out, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"
    for part in range(3):
        every.filter(F.col("part") == part).drop("part").write.mode("append").parquet(src)
        q = summaries.keep_case_money(spark.readStream.schema(odd.schema).parquet(src), out, check)
        q.awaitTermination()
        got = sorted(map(tuple, summaries.kept(spark, out).collect()))
        assert got == sorted(map(tuple, summaries.case_money(spark.read.parquet(src)).collect()))
    # against plain sums
    rows = every.filter("case_id is not null").collect()
    want = {}
    for r in rows:
        want.setdefault(r.case_id, []).append(r)
    for case, n, numeric, total, largest, names, documents in got:
        of = want[case]
        counted = [r for r in of if r.normalized_amount is not None and "NON" not in (r.amount_display or "")]
        assert n == len(of) and total == math.fsum(r.normalized_amount for r in counted)
        assert largest == [r.id for r in sorted(counted, key=lambda r: (-r.normalized_amount, r.id))[:5]]
        assert names == len({r.entity_name.strip().lower() for r in of if r.entity_name is not None})
        exact = len({r.document_id for r in of if r.document_id is not None})
        assert documents == exact if exact <= summaries.EXACT else abs(documents - exact) < 0.1 * exact
    assert len(got) == len(want) and dict((r[0], r[3]) for r in got)[900] == 0.1 + 0.2 + 0.2


def test_many_distinct_values_count_exactly(spark):
    rows = spark.range(40_000).selectExpr("id", "id % 2 as case_id", "id % 12345 as document_id", "concat('n', id % 3001) as entity_name", "1.0D as normalized_amount", "'$1' as amount_display", "'GRANT' as signal_type")
    got = {r.case_id: (r.n_signals, r.total, r.n_names, r.n_documents) for r in summaries.case_money(rows.repartition(5)).collect()}
    assert got == {0: (20_000, 20_000.0, 3001, 12_345), 1: (20_000, 20_000.0, 3001, 12_345)}


def test_parts_merge_in_any_order():
    rng = random.Random(1)
    hashes = [rng.getrandbits(64) - (1 << 63) for _ in range(5000)]
    ways = []
    for seed in range(3):
        own = hashes[:]
        random.Random(seed).shuffle(own)
        d = summaries.Distinct()
        for i in range(0, 5000, 700):
            part = summaries.Distinct()
            part.add(own[i : i + 700])
            d.merge(part)
        ways.append((d.registers, d.count()))
    assert ways[0] == ways[1] == ways[2] and abs(ways[0][1] - 5000) < 500
    numbers = [rng.uniform(-1e12, 1e12) for _ in range(200)] + [1e300, 1e-300, -1e300]
    for _ in range(5):
        rng.shuffle(numbers)
        assert math.fsum(summaries._exact(summaries._exact(numbers[:100]) + summaries._exact(numbers[100:]))) == math.fsum(numbers)


def test_touched_cases_are_compiled_again(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "case_id long, document_id long"
    for rows in ([(1, 1), (2, 2)], [(2, 3)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        compile_ = lambda touched: spark.read.parquet(src).join(touched, "case_id", "left_semi").groupBy("case_id").count()
        flows.recompile_touched(spark.readStream.schema(schema).parquet(src), compile_, out, f"{tmp_path}/check").awaitTermination()
    assert {r.case_id: r["count"] for r in spark.read.parquet(out).collect()} == {1: 1, 2: 2}


def test_log_feed_counts(spark, tmp_path, sf_dir):
    schema = "id long, event_type string, created_at timestamp"
    spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id as id", "event_type", "ts as created_at").write.parquet(f"{tmp_path}/in")
    feed = flows.log_feed(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "1 hour")
    feed.writeStream.format("memory").queryName("log_feed").outputMode("complete").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("log_feed").agg(F.sum("n")).first()[0] == 1000


def test_urls_are_taken_once(spark, tmp_path):
    schema = "source_url string, arrived_at timestamp"
    spark.sql("select * from values ('u', timestamp'2024-01-01 00:00:00'), ('u', timestamp'2024-01-01 01:00:00'), ('v', timestamp'2024-01-01 00:00:00') as t(source_url, arrived_at)").write.parquet(f"{tmp_path}/in")
    fresh = flows.fresh_documents(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    fresh.writeStream.format("memory").queryName("fresh").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.source_url for r in spark.table("fresh").collect()) == ["u", "v"]


def test_feed_items(spark):
    xml = (
        '<rss><item><title>Council approves budget &amp; more - The Herald</title><link>https://news.example.com/r/1</link><pubDate>Mon</pubDate>'
        '<description>&lt;b&gt;Bold&lt;/b&gt; words</description><source url="https://www.herald.com/a.pdf">The Herald</source></item>'
        "<item><title></title><link>x</link></item><item><title>Short - x</title><guid>https://b.org/2</guid></item></rss>"
    )
    rows = feed_items(spark.createDataFrame([(7, xml)], "case_id long, xml string")).orderBy("seq").collect()
    assert [(r.title, r.url, r.source, r.content_type) for r in rows] == [("Council approves budget & more", "https://www.herald.com/a.pdf", "The Herald", "pdf"), ("Short - x", "https://b.org/2", "b.org", "web-article")]
    assert rows[0].case_id == 7 and rows[0].publish_date == "Mon"
