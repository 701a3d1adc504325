from casework.operators import budgets, compiling, dossier, names

TEXT = """City of Harbor Adopted Budget FY 2024
GENERAL FUND
Parks Department
Salaries 1,200,000 1,300,000
10-200 Supplies: 45,500
Salaries 1,200,000
Subtotal 1,245,500
PUBLIC SAFETY
Police Office
Cars 900,000
Fee 1,000"""


def test_rows_with_their_headings(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "no numbers here"), (3, None)], "document_id long, text string")
    assert [r.document_id for r in docs.filter(budgets.is_budget(budgets.F.col("text"))).collect()] == [1]
    rows = budgets.budget_rows(docs).orderBy("pos").collect()
    assert [(r.label, r.amount, r.section, r.department) for r in rows] == [
        ("Salaries", 1_200_000.0, "GENERAL FUND", "Parks Department"),
        ("Supplies", 45_500.0, "GENERAL FUND", "Parks Department"),
        ("Cars", 900_000.0, "PUBLIC SAFETY", "Police Office"),
        ("Fee", 1_000.0, "PUBLIC SAFETY", "Police Office"),
    ]
    assert rows[3].entity_name == "Police Office" and rows[0].fiscal_year == "2024"


def test_briefs_round_trip(spark, tmp_path):
    briefs = spark.createDataFrame([(1, "STRONG", 80), (2, None, 3)], "case_id long, quality string, confidence int")
    compiling.write_briefs(briefs, f"{tmp_path}/b")
    stored = spark.read.parquet(f"{tmp_path}/b").union(spark.createDataFrame([(3, "{broken")], "case_id long, brief string"))
    got = {r.case_id: r.brief for r in compiling.read_briefs(stored, "quality string, confidence int").collect()}
    assert got[1].confidence == 80 and got[2].quality is None and got[3] is None


def test_log_is_appended(spark, tmp_path):
    e = spark.createDataFrame([("x", "m", 1)], "event_type string, message string, case_id long")
    dossier.append_log(e, f"{tmp_path}/log")
    dossier.append_log(e, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2


def test_resolution(spark):
    have = spark.createDataFrame([(1, "Harbor Water Authority", 1), (1, "Apex Construction Group", 2), (1, "Bo", 3)], "case_id long, name string, id long")
    ask = spark.createDataFrame([(1, "the Harbor Water Authority's"), (1, "Harbor Water"), (1, "Apex Construction Partners"), (1, "Bob"), (2, "Harbor Water")], "case_id long, name string")
    got = {(r.case_id, r.candidate): r.canonical for r in names.resolved(ask, have).collect()}
    assert got == {(1, "the Harbor Water Authority's"): "Harbor Water Authority", (1, "Harbor Water"): "Harbor Water Authority", (1, "Apex Construction Partners"): "Apex Construction Group", (1, "Bob"): None, (2, "Harbor Water"): None}
