"""Search results: reading feeds, one row a url, few a host, the best of each case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.functions.text import host, plain_text
from casework.operators.ranking import first_by, top_by


def _tag(item: Column, name: str) -> Column:
    inner = F.regexp_extract(item, rf"(?s)<{name}[^>]*>(.*?)</{name}>", 1)
    return F.trim(F.regexp_replace(inner, r"(?s)^<!\[CDATA\[(.*?)\]\]>$", "$1"))


def feed_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """One row for each item of each feed: seq, title, url, source, snippet, publish_date, content_type."""
    items = feeds.select("*", F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))).alias("seq", "item"))
    item = F.col("item")
    title = plain_text(_tag(item, "title"))
    cut = F.length(title) - F.length(F.substring_index(title, " - ", -1)) - 3  # where the last " - " starts
    link = F.coalesce(F.nullif(_tag(item, "link"), F.lit("")), F.nullif(_tag(item, "guid"), F.lit("")))
    source_url = F.nullif(F.regexp_extract(item, r'<source\s+url="([^"]+)"', 1), F.lit(""))
    source = F.nullif(F.trim(F.regexp_extract(item, r'<source\s+url="[^"]+"[^>]*>([^<]*)</source>', 1)), F.lit(""))
    url = F.coalesce(source_url, link)
    out = items.select(
        *feeds.drop(xml).columns,
        "seq",
        F.when(cut > 10, F.substring(title, F.lit(1), cut)).otherwise(title).alias("title"),
        url.alias("url"),
        F.coalesce(source, host(link)).alias("source"),
        F.substring(plain_text(_tag(item, "description")), 1, 280).alias("snippet"),
        F.nullif(_tag(item, "pubDate"), F.lit("")).alias("publish_date"),
        F.when(F.lower(url).contains(".pdf"), "pdf").otherwise("web-article").alias("content_type"),
    )
    return out.filter("title <> '' and url is not null")


def chosen(results: DataFrame, per_host: int = 3, least: float = -2.0, k: int = 12) -> DataFrame:
    """Of results (case_id, seq, url, score): the first of each url, at most per_host of a host, the k best of each case."""
    one = first_by(results, ["case_id", "url"], ["seq"]).withColumn("host", host(F.col("url")))
    few = top_by(one, ["case_id", "host"], ["seq"], per_host).drop("rank")
    return top_by(few.filter(F.col("score") >= least), ["case_id"], [F.desc("score"), "seq"], k)
