"""Page text from HTML, natively: the stand-in for page extraction from binary documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_text(pages: DataFrame) -> DataFrame:
    """Title as section, tag-free text with white space collapsed, and its size; pages without text are kept."""
    body = F.regexp_replace("html", r"(?is)<(script|style|head)\b.*?</\1>|<!--.*?-->", " ")
    bare = F.trim(F.regexp_replace(F.regexp_replace(body, r"<[^>]*>", " "), r"\s+", " "))
    title = F.trim(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1))
    return pages.select("page_id", "url", title.alias("section"), bare.alias("text")).withColumn("n_chars", F.char_length("text"))
