import zlib

from pyspark.sql import functions as F

from casework.llm import langid, queries


def test_query_held_out_accuracy(spark):
    rows = queries.op6_langid(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows) and held
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_families_and_odd_rows(spark):
    docs = [(i, t * 5, g) for i in range(40) for t, g in (("the house and the tree ", "a"), ("the mouse and the bee ", "b"), ("qui est la fille que ", "c"), ("que es la villa qui ", "d"))]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.train(df, F.lit(True))
    assert sorted(map(sorted, model.families)) == [["a", "b"], ["c", "d"]]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 --"), (None, "the mouse and the bee " * 3)], "doc_id long, text string")
    got = {r.doc_id: r._lang for r in langid.identify(odd, model).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1, 2, 3)) and got[None].lang_pred == "b"
    assert langid.train(df.filter("false"), F.lit(True)) is None
    assert {r._lang.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0


def test_clashing_names_and_a_very_long_text(spark):
    df = spark.createDataFrame([(i, t * (5 if i else 60_000), g, 7) for i in range(20) for t, g in (("the house and the tree ", "a"), ("qui est la fille que ", "b"))], "doc_id long, text string, lang string, _lang int")
    model = langid.train(df, F.lit(True))
    out = langid.identify(df, model, out="found")
    assert out.columns == [*df.columns, "found"] and out.filter("found.lang_pred = lang").count() == 40
    assert langid.identify(df, model).filter("_lang.lang_pred = lang").count() == 40
