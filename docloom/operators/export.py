"""Exports: JSON, CSV, Markdown and OPML, one row a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_of

CSV_COLUMNS = ("title", "url", "source", "author", "published", "score", "state", "topics", "tags", "summary")


def csv_escape(c: Column) -> Column:
    """Quoted if it holds a quote, comma or line end."""
    text = text_of(c)
    return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_rows(items: DataFrame) -> DataFrame:
    """id, line of each item; the header and byte-order mark are ``csv_header``."""
    iso = F.date_format(F.timestamp_millis(F.col("published_ms")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    values = {
        "title": F.col("title"), "url": F.col("url"), "source": F.col("source"), "author": F.coalesce(F.col("author.name"), F.col("author.handle")), "published": iso, "score": F.col("score").cast("string"),
        "state": F.col("state"), "topics": F.array_join("topics", "|"), "tags": F.array_join("tags", "|"), "summary": F.substring(F.trim(F.regexp_replace(text_of(F.col("summary")), r"\s+", " ")), 1, 500),
    }
    return items.select("id", F.concat_ws(",", *(csv_escape(values[c]) for c in CSV_COLUMNS)).alias("line"))


def csv_header() -> str:
    return "﻿" + ",".join(CSV_COLUMNS)


def write_csv(items: DataFrame, path: str) -> None:
    """A folder of CSV parts with the columns of ``csv_rows``."""
    csv_rows(items).select(F.col("line").alias("value")).write.text(path)


def markdown(items: DataFrame) -> DataFrame:
    """id, section of each item."""
    by = F.coalesce(F.col("author.name"), F.col("author.handle"))
    meta = F.concat_ws(" · ", F.col("source"), by, F.date_format(F.timestamp_millis(F.col("published_ms")), "yyyy-MM-dd"), F.concat(F.lit("score "), F.col("score").cast("int").cast("string")))
    tags = F.when(F.size(F.coalesce(F.col("tags"), F.array().cast("array<string>"))) > 0, F.concat(F.lit("Tags: "), F.array_join("tags", ", ")))
    return items.select("id", F.concat_ws("\n\n", F.concat(F.lit("## ["), text_of(F.col("title")), F.lit("]("), F.col("url"), F.lit(")")), meta, F.nullif(F.trim(text_of(F.col("summary"))), F.lit("")), tags).alias("section"))


def json_rows(items: DataFrame, highlights: DataFrame | None = None) -> DataFrame:
    """id, json of each item, with its highlights."""
    if highlights is not None:
        own = highlights.groupBy(F.col("item_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("created_ms", "text", "note"))).alias("highlights"))
        items = items.join(own, "id", "left")
    return items.select("id", F.to_json(F.struct("*")).alias("json"))


def xml_escape(c: Column) -> Column:
    out = text_of(c)
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def opml(sources: DataFrame, title: str = "docloom sources") -> DataFrame:
    """One row: the OPML of the feeds among ``sources``."""
    label = xml_escape(F.coalesce(F.col("label"), F.col("target")))
    line = F.concat(F.lit('    <outline type="rss" text="'), label, F.lit('" title="'), label, F.lit('" xmlUrl="'), xml_escape(F.col("target")), F.lit('"/>'))
    rows = sources.filter(F.col("kind") == "rss").select(F.col("target"), line.alias("line")).agg(F.sort_array(F.collect_list(F.struct("target", "line"))).alias("rows"))  # a user's feeds
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<opml version="2.0">\n  <head><title>{title}</title></head>\n  <body>\n'
    return rows.select(F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n  </body>\n</opml>\n")).alias("opml"))
