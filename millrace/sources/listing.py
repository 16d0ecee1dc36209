"""Parsing of raw HTML pages with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unescape(text: Column) -> Column:
    """The named entities of markup itself; & comes last, so that nothing is unescaped twice."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def parse_pages(pages: DataFrame) -> DataFrame:
    html = F.col("html")
    title = unescape(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1))
    return pages.select("page_id", F.regexp_extract(html, '<html lang="([a-z]+)"', 1).alias("lang"), title.alias("title"), F.regexp_count(html, F.lit("<a href=")).cast("long").alias("links"))
