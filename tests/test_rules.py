"""Rules on mentions, money and documents that the test tables' queries do not reach."""

import duckdb
from pyspark.sql import functions as F

from casework.functions import mention_rules as rules
from casework.functions import pages, parties, text
from casework.operators import articles, extraction, mentions, promotion
from casework.plans.registry import ORACLE_SQL, QUERIES
from casework.sources import views


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_parties_of_an_audit_report(spark):
    body = [
        "MTA awarded a $12.8 million infrastructure contract to Apex Construction Group on January 5, 2024.",
        "In March, MTA awarded $8.3 million to Ridgeline Systems Inc for signals.",
        "Office of Inspector General allocated $1.2 million for the audit of the contract.",
        "The concert raised $2 million for a grant.",
    ]
    rows = [(1, i, s) for i, s in enumerate(body)]
    df = spark.createDataFrame(rows, "document_id long, pos int, sentence string").withColumn("words", F.array(F.lit("mta"), F.lit("contract")))
    got = {r.amount_display: (r.controlled_by, r.received_by) for r in extraction.money_signals(df).collect()}
    assert got == {"$12.8M": ("MTA", "Apex Construction Group"), "$8.3M": ("MTA", "Ridgeline Systems Inc"), "$1.2M": ("Office of Inspector General", None)}


def test_what_names_a_party(spark):
    rows = [("In January",), ("The Office",), ("the office",), ("MTA",), ("Marc",), ("LA County",), (None,), ("ab",), ("Harbor",)]
    got = dict(values(spark, rows, "n string", "n", parties.is_party(F.col("n"))))
    assert [k for k, v in got.items() if v] == ["MTA", "LA County", "Harbor"]
    assert values(spark, [("HUD.",), ("la metro",), (" Other Org ",)], "n string", parties.canonical(F.col("n"))) == [("HUD",), ("MTA",), ("Other Org",)]


def test_shown_amounts(spark):
    rows = [("$12.8 million",), ("$12.80 million",), ("USD 45,000",), ("£3 bn",), ("$1,234.50",), ("3.5 billion",)]
    raw = F.col("raw")
    assert [r[0] for r in values(spark, rows, "raw string", parties.display(raw, text.amount_value(raw)))] == ["$12.8M", "$12.8M", "$45,000", "£3B", "$1,234.5", "$3.5B"]


def test_shapes_of_names(spark):
    names = {
        "Jordan Petrov": (False, False, False), "James Comer Steve": (False, True, False), "Next Mike Crapo": (False, True, True), "Los AngelesRoanoke City": (False, True, False),
        "MORE NEWS EAU CLAIRE": (True, True, True), "Harbor Council of Metro": (True, False, False), "With Amy Juravich": (True, False, False), "$5 million": (True, False, False), "Jordan": (True, False, False), "Subscribe": (True, False, True),
    }
    n = F.col("n")
    got = {r[0]: r[1:] for r in values(spark, [(k,) for k in names], "n string", "n", rules.is_misshapen(n, F.lit("person")), rules.is_merged(n), rules.is_menu_text(n))}
    assert got == names


def test_types_and_validity(spark):
    n, k = F.col("n"), F.col("k")
    rows = [("Harbor Fund", "person"), ("HUD", "organization"), ("ABC", "person"), ("Jordan Petrov", "person"), ("Apex LLC", "person")]
    assert [r[0] for r in values(spark, rows, "n string, k string", rules.corrected_type(n, k))] == ["organization", "agency", "agency", "person", "organization"]
    rows = [("Governor", "person"), ("Budget", "organization"), ("Harbor Council's", "organization"), ("Meet the Press", "organization"), ("Harbor Council", "organization"), ("12", "organization")]
    assert [r[0] for r in values(spark, rows, "n string, k string", rules.is_valid(n, k))] == [False, False, False, False, True, False]


def test_whole_documents_to_admitted_mentions(spark):
    lead = "The Department of Housing approved a grant for the shelter program after an audit of the contract."
    rows = [(1, 1, lead + "\nRead more: Harbor Bank Group is here\n" + "Metro Trust Holdings took part in the audit. " * 3, "finance_funding", ["housing"], False), (2, 1, None, "general", [], False), (3, 1, "", "general", [], True)]
    df = spark.createDataFrame(rows, "document_id long, case_id long, text string, intent string, terms array<string>, lead_only boolean")
    got = {r.entity_name: r for r in extraction.extracted(df).collect()}
    assert got["Department of Housing"].role == "GOVERNMENT_AGENCY" and got["Department of Housing"].topic == "HIGH" and got["Department of Housing"].reject_reason is None
    assert "Harbor Bank Group" not in got
    blocked = extraction.extracted(df, lists=lambda n: {"blocked": n == "Department of Housing"})
    assert "Department of Housing" not in [r.entity_name for r in blocked.collect()]
    listed = extraction.without_listed(extraction.extracted(df), spark.createDataFrame([("Department of Housing",)], "name string"))
    assert "Department of Housing" not in [r.entity_name for r in listed.collect()] and extraction.extracted(df.limit(0)).count() == 0


def test_names_are_given_once_and_mentions_move_once(spark):
    text_ = "The audit of Harbor Council and Jordan Petrov goes on. " * 40
    df = spark.createDataFrame([(i, 1, text_, "finance_funding", ["harbor"], i % 2 == 0) for i in range(4)], "document_id long, case_id long, text string, intent string, terms array<string>, lead_only boolean")
    found = df.select(F.explode(mentions.find_names(F.col("text"))).alias("m")).select("m.*")
    assert found.count() == 4 * found.select("name", "type").distinct().count()
    out = extraction.extracted(df).drop("context")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted({(r.document_id, r.entity_name) for r in out.collect()}) == [(i, n) for i in range(4) for n in ("Harbor Council", "Jordan Petrov")]


def test_seed_and_diag_maps(spark):
    rows = [("Case [SEED:searched=4|searched=7|seed_intent=general|reject_reasons=ARTIFACT%3A3%2CNAV%3A1|next_queries=a%20b%7C%7Cc]",), ("plain",), (None,)]
    got = [r[0] for r in values(spark, rows, "d string", text.seed_map(F.col("d")))]
    assert got[1] is None and got[2] is None
    assert got[0].counts == {"searched": 7} and got[0].reject_reasons == {"ARTIFACT": 3, "NAV": 1} and got[0].next_queries == ["a b", "c"]
    found = values(spark, [("[DIAG:status=ok|score=3|score=8|url=http%3A%2F%2Fa.b%2Fc] body",)], "d string", text.diag_fields(F.col("d")))[0][0]
    assert (found.status, found.score, found.url, found.chars) == ("ok", 8, "http://a.b/c", None)
    assert values(spark, [("a b/c",)], "u string", text.diag_encode(urls=("url",), url=F.col("u"))) == [("[DIAG:url=a%20b%2Fc]",)]


def test_wrappers_and_seeds(spark):
    rows = [("<html>x", "https://news.google.com/x", "y" * 200), ("<html>x", "https://a.b", "y" * 200), ("We use cookies to", "https://a.b", "y" * 200), ("x", "https://a.b", "short"), ("x", "https://a.b", "Enable JavaScript " + "y" * 150)]
    assert [r[0] for r in values(spark, rows, "h string, u string, t string", pages.is_wrapper(F.col("h"), F.col("u"), F.col("t")))] == [True, False, True, True, True]


def test_one_giant_case_is_promoted_like_a_small_one(spark):
    m = spark.range(3000).select("id", F.lit(1).cast("long").alias("case_id"), (F.col("id") % 900).alias("document_id"), F.concat(F.lit("Office of "), F.col("id") % 700).alias("entity_name"), F.lit("agency").alias("entity_type"), F.lit(0.9).alias("confidence"), F.lit("OFFICIAL").alias("role"), F.lit("HIGH").alias("topic"), F.lit("lead").alias("zone"), F.lit("a grant").alias("context"))
    own = m.select("case_id", text.normalized_name(F.col("entity_name")).alias("name_key")).distinct().withColumn("cluster", F.col("name_key"))
    facts = spark.range(900).select(F.col("id").alias("document_id"), F.lit("t").alias("title"), F.lit("PRIORITY_A").alias("priority"), F.lit("CORE").alias("tier"), F.lit("low").alias("contamination"))
    cases = spark.createDataFrame([(1, "Harbor", "general", 9, 9)], "case_id long, target string, intent string, n_aligned int, n_usable int")
    out = promotion.promoted(promotion.features(m, own, facts), cases)
    assert out.filter("decision = 'promoted'").count() == 5 and out.filter("decision = 'promoted'").agg(F.max("first_id")).first()[0] == 4 and out.count() == 700


def test_articles_of_pages(spark):
    para = "The council of the county approved the budget of the shelter program for the next year, and the audit goes on. "
    page = lambda inner: f"<html><body><nav>menu</nav>{inner}<footer>end</footer></body></html>"
    rows = [
        (1, page(f"<div class='side'>{'x ' * 400}</div><article>{''.join(f'<p>{para * 2}</p>' for _ in range(5))}</article>")),
        (2, '<script type="application/ld+json">{"articleBody": "' + para * 20 + '"}</script><p>short</p>'),
        (3, page("".join(f"<p>{para}</p>" for _ in range(6)))),
        (4, page("few words")),
        (5, None),
        (6, "<p>Subscribe to read " + para * 12),
    ]
    got = {r.page_id: r for r in articles.articles(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got[1].label == "article" and got[1].text.count("council") == 10 and got[1].status == "valid" and "menu" not in got[1].text
    assert got[2].label == "json-ld" and got[3].label == "p-aggregate" and got[3].n_paragraphs == 6
    assert got[4].label == "body" and got[4].text == "few words" and got[4].status == "invalid" and got[5].text == "" and got[6].status == "invalid"


def test_files_and_cases(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "Report of May.MD").write_text("one\ntwo")
    (tmp_path / "in" / "b.txt").write_text("")
    got = {r.title: r for r in views.read_files(spark, str(tmp_path / "in")).collect()}
    assert got["Report of May"].raw_text == "one\ntwo" and got["Report of May"].extension == "md"
    t = views.bucketed(spark.range(100).select((F.col("id") % 10).alias("case_id"), "id"), 8)
    assert views.of_case(t, 3, 8).count() == views.of_case(t, 3).count() == 10


def test_seed_counters(spark):
    docs = spark.createDataFrame([(1, "PRIORITY_A", "CORE", False), (1, "NOISE", "CONTAMINATED", True), (2, "PRIORITY_B", "RELEVANT", False)], "case_id long, priority string, tier string, failed boolean")
    found = spark.createDataFrame([(1, None), (1, "ARTIFACT"), (3, "NAV_RESIDUE")], "case_id long, reject_reason string")
    done = spark.createDataFrame([(1, "promoted", 3), (1, "held", 9)], "case_id long, decision string, n_documents int")
    got = {r.case_id: r for r in promotion.seed_counters(docs, found, done).collect()}
    assert (got[1].documents, got[1].failed, got[1].priority_a, got[1].admitted, got[1].artifact_rejected, got[1].promoted, got[1].held, got[1].main_support) == (2, 1, 1, 1, 1, 1, 1, 3)
    assert got[2].promoted == 0 and got[3].nav_rejected == 1


def test_faults_of_null_texts_and_dotted_capitals_equal_their_sql(spark, tmp_path):
    body = "The council met and the report of the budget came to the table of the members again. "
    texts = [None, None, None, None, None, "", "Sİgn in to read " + body, "Clİck here. Read more. " + body, body * 9 + "\n\n" + body + "PRİVACY POLICY.\n\n", "Sİgn in. Log İn. Subscrİbe. Copy lİnk. " + body, body * 12]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["text_faults"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"select id, boilerplate, menu, paragraphs, status from ({ORACLE_SQL['text_faults']}) order by id").fetchall()
    assert list(map(tuple, got.orderBy("id").select("id", "boilerplate", "menu", "paragraphs", "status").collect())) == want
