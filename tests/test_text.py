import datetime

from pyspark.sql import functions as F

from casework.functions import documents, pages, text
from casework.operators import budgets, money, timeline


def test_dates_of_short_months(spark):
    want = {
        "The board approved it on Mar. 3": "2001-03-03",
        "It was signed on Jan. 5, 2021": "2021-01-05",
        "The audit began in Sep 2020": "2020-09-01",
        "The audit began in sep. 2020": "2020-09-01",
        "Approved Dec 2019, effective March 4, 2020": "2019-12-01",
        "Approved Dec 1, 2019, effective March 4, 2020": "2020-03-04",
        "Approved in May 2018": "2018-05-01",
        "Approved on May 7": "2001-05-07",
        "The janitor left in 2017": "2017-01-01",
        "Feb 31 2020": "2020-01-01",
        "No date at all": None,
    }
    got = {r.s: r.d for r in spark.createDataFrame([(s,) for s in want], "s string").select("s", text.event_date(F.col("s")).alias("d")).collect()}
    assert got == {s: d and datetime.date.fromisoformat(d) for s, d in want.items()}


def test_event_with_a_short_month_is_kept(spark):
    df = spark.createDataFrame([(1, 0, "The council approved the plan on Mar. 3, 2020")], "document_id long, pos int, sentence string")
    assert [r.event_date for r in timeline.strict_events(df).collect()] == [datetime.date(2020, 3, 3)]


def test_amounts_without_a_sign(spark):
    want = {
        "a grant of 12 million dollars was paid": [12e6],
        "paid 3.5 billion and $2 million": [3.5e9, 2e6],
        "1,250 thousand US dollars, USD 4,000 and £3m": [1.25e6, 4000.0, 3e6],
        "$12 million dollars": [12e6],
        "about 12 mills and 1999 people": [],
    }
    found = F.transform(text.amounts(F.col("s")), text.amount_value)
    assert {r.s: r.a for r in spark.createDataFrame([(s,) for s in want], "s string").select("s", found.alias("a")).collect()} == want


def test_sentence_gates(spark):
    told = ["A grant of 12 million dollars was paid", "The NFL club paid a contract of $3 million", "The gala paid $4 million of the budget", "The film earned $5 million, paid in part", "The budget paid $6 million"]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(told)], "document_id long, pos int, sentence string")
    assert sorted((r.pos, r.amount) for r in money.sentence_signals(df).collect()) == [(0, 12e6), (4, 6e6)]


def test_budget_column_and_years(spark):
    rows = "Roads 1,000\nParks 2,000"
    docs = spark.createDataFrame([(1, f"Budget F.Y. 2023-24\nRevised Adopted\n{rows}"), (2, f"Budget FY 2023/24\n{rows}"), (3, "x\n" * 30 + f"Adopted\n{rows}")], "document_id long, text string")
    got = {(r.document_id, r.column_label, r.fiscal_year) for r in budgets.budget_rows(docs).collect()}
    assert got == {(1, "REVISED", "2023-24"), (2, "ALLOCATION", "2023/24"), (3, "ALLOCATION", None)}


def test_density_of_a_text_of_short_pieces(spark):
    # each piece but the first has 15 letters after its space: no sentence, so a menu
    df = spark.createDataFrame([("MENTE!! " + "ABCDEFGHIJKLMNO!! " * 30,)], "t string")
    assert df.select(documents.density(F.col("t")).alias("d")).first().d == 0


def test_lines_and_paragraphs_without_spaces_at_their_ends(spark):
    t = "One 1 line here.\n" + "\n".join(["\u00a0 1 short line \u00a0", " " * 60, "2 " + "x" * 36 + "  "] * 6)
    last = "It was 1" + "y" * 70 + ".1"
    df = spark.createDataFrame([(t, f"a\n\n{last}\n\n  b  ", ["  0x0 ", "1x1", "\u30002x2", ""])], "t string, p string, l array<string>")
    got = df.select(pages.is_menu(F.col("t")).alias("menu"), pages.paragraphs(F.col("p")).alias("n"), pages.trimmed_all(F.col("l")).alias("l")).first()
    assert got.menu and got.n == 1 and got.l == ["0x0", "1x1", "2x2", ""]


def test_status_of_a_text_of_short_pieces(spark):
    # a sentence, and pieces that are long enough with the space before them alone
    t = "A" + "b " * 250 + "end. " + "ABCDEFGHIJKLMNO!! " * 30
    got = spark.createDataFrame([(t,)], "t string").select(pages.is_menu(F.col("t")).alias("menu"), pages.extraction_status(F.col("t"), F.lit(50)).alias("status")).first()
    assert (got.menu, got.status) == (True, "invalid")


def test_lines_are_lowered_once(spark):
    # once for each of the five places that name the lines, not for each word
    df = spark.createDataFrame([("Share\n Body \nRead more\nEmail Print Close",)], "t string")
    out = df.select(documents.cleaned(F.col("t")).alias("c")).select("c.cleaned", "c.boilerplate_ratio")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(") <= 5 and out.first().cleaned == "Body"


def test_lines_are_searched_in_arrow_batches(spark):
    long_ = "word " * 30 + "share email print"  # three words of share rails, whatever the length
    texts = [None, "", "\n \n", "Share\r\n Body \r\r\n\u00a0Read more\u2003\nEmail Print Close\nLast\r", "Copyright 2020 x\nKeep\n\n\n\nthis\nclose\nclose it", f"\t{long_}\nA\n", "sign up for us\nprint print print\n12/30 pm\n\u2022\u2192\n---"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("c", documents.cleaned(F.col("t")))
    got = [tuple(r.c) for r in df.orderBy("i").collect()]
    assert got[0] == (None, None, None, None, 0.0)
    left = [("", 1), ("", 3), ("Body \r\nLast", 3), ("Keep\nthis\nclose it", 5), ("A", 2), ("print print print", 4)]
    assert got[1:] == [(x, len(t), len(x), n, round((len(t) - len(x)) / len(t), 4) if t else 0.0) for t, (x, n) in zip(texts[1:], left, strict=True)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "rlike" not in plan.lower()


def test_foreign_lines_are_counted_in_arrow_batches(spark):
    heads = "\n".join(["Harbor Council Votes Again\r", "  THE WHOLE BUDGET OF IT ", "Short One Here", "Not a Headline of That Kind"] * 3)
    texts = [None, "", heads, "Read more\nread more now\n\u00a0More news today\nx", "10:30 am\n" * 5 + "share " + "y" * 90, "Sponsored story\nemail us\n"]
    df = spark.createDataFrame([(i, t, 0.3 if i == 5 else 0.0) for i, t in enumerate(texts)], "i int, t string, r double")
    d = documents.contamination(df, "t", "r")
    got = [(r.contamination_points, r.contamination, r.contamination_signals) for r in d.orderBy("i").collect()]
    assert got == [
        (0, "low", []), (0, "low", []), (2, "low", ["headline-fragments"]), (6, "high", ["more-stories-bleed", "multiple-more-stories", "short-noisy"]), (1, "low", ["timestamp-clusters"]),
        (8, "high", ["med-boilerplate", "heavy-nav-density", "promo-content", "short-noisy"]),
    ]
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "rlike" not in plan.lower() and "_lines" not in d.columns
