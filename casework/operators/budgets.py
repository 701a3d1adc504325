"""Rows of budget documents: label and first amount of each line, with the section and department above it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casework.operators.ranking import first_by, top_by

# Words of budgets, headings of their columns, labels that are no rows.
VOCABULARY = r"(?i)\b(fiscal\s+year|adopted\s+budget|approved\s+budget|operating\s+budget|capital\s+budget|budget\s+summary|budget\s+detail|budget\s+report|municipal\s+budget|government\s+budget|fy\s*\d{2,4}|appropriation|expenditure|encumbrance|general\s+fund|special\s+revenue|department\s+budget|budget\s+appropriation)\b"
COLUMNS = r"(?i)\b(adopted|revised|actual|proposed|variance|budgeted|appropriated)\b.*\b(adopted|revised|actual|proposed|variance|budgeted|appropriated)\b"
NO_ROW = r"(?i)^\s*(total|subtotal|grand total|net|net total|less|plus|add|deduct|balance|carry|rollover|reserve|contingency|unallocated|fund balance)\b"
FIRST_COLUMN = r"(?i)\b(adopted|approved|proposed|revised|amended|actual|variance|estimated|budgeted)\b"
FISCAL_YEAR = r"(?i)\b(?:FY|Fiscal Year|F\.Y\.)\s*(\d{2,4}(?:[–\-/]\d{2,4})?)\b"
NUMBER = r"\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b"


def is_budget(c: Column) -> Column:
    """At least five numbers with thousands' commas, and budget words or two column headings on a line."""
    return (F.length(c) >= 100) & (F.regexp_count(c, F.lit(NUMBER)) >= 5) & (c.rlike(VOCABULARY) | c.rlike(COLUMNS))


def budget_rows(documents: DataFrame, k: int = 60) -> DataFrame:
    """(document_id, pos, label, amount, section, department, fiscal_year, column_label) of documents (document_id, text); the first k of each.

    The column label is the first column heading of the first 30 lines, in capitals, ALLOCATION if none.

    Section (capitals) and department (title case) are carried forward by a running last value over
    the lines of a document.
    """
    d = documents.withColumn("fiscal_year", F.nullif(F.regexp_extract(F.substring("text", 1, 500), FISCAL_YEAR, 1), F.lit("")))
    heading = F.upper(F.regexp_extract(F.substring_index("text", "\n", 30), FIRST_COLUMN, 1))
    d = d.withColumn("column_label", F.coalesce(F.nullif(heading, F.lit("")), F.lit("ALLOCATION")))
    lines = d.select("document_id", "fiscal_year", "column_label", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    number = F.regexp_extract("line", NUMBER, 0)
    label = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.substring("line", F.lit(1), F.greatest(F.lit(0), F.position(number, F.col("line")) - 1)), r"^\d{2,}[-.\s]\d{2,}([-.\s]\d+)*\s*", "")), r"[:\-|]+$", ""))
    lines = lines.withColumns({"number": number, "label": F.when(number != "", label)})
    lines = lines.withColumn("is_row", (F.col("number") != "") & (F.length("label") >= 2) & ~F.col("label").rlike(NO_ROW) & F.col("label").rlike("[A-Za-z]"))
    sized = (F.length("line") >= 5) & (F.length("line") <= 80) & (F.col("number") == "")
    caps = sized & F.col("line").rlike(r"^[A-Z][A-Z &\-/]+$")
    title = sized & ~caps & (F.length("line") <= 50) & F.col("line").rlike(r"^[A-Z][a-zA-Z &\-/]+$")
    above = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumns({"section": F.last(F.when(caps, F.col("line")), ignorenulls=True).over(above), "department": F.last(F.when(title, F.col("line")), ignorenulls=True).over(above)})
    rows = lines.filter("is_row").withColumn("amount", F.regexp_replace("number", ",", "").cast("double")).filter("amount >= 1000")
    entity = F.when(F.length("label") > 4, F.col("label")).otherwise(F.coalesce("department", "section", "label"))
    one = first_by(rows.withColumn("entity_name", entity), ["document_id", "entity_name", "number"], ["pos"])
    return top_by(one, ["document_id"], ["pos"], k).select("document_id", "pos", "entity_name", "label", "amount", "section", "department", "fiscal_year", "column_label")
