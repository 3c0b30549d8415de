"""RSS, Atom and RDF feeds. Wild feeds are seldom well-formed XML, so they are scanned, in a table function over whole files."""

from __future__ import annotations

import re
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import struct

ENTRY = struct("title string, link string, description string, content string, author string, published_ms long, categories array<string>, enclosure string")
MOST_ENTRIES, MOST_CATEGORIES = 120, 12


def decoded(text: str | None) -> str:
    """Text of an element: CDATA unwrapped, references resolved, ampersands last."""
    text = re.sub(r"<!\[CDATA\[(.*?)\]\]>", r"\1", text or "", flags=re.DOTALL)

    def char(code: int) -> str:
        return chr(code) if 0 <= code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else ""

    for name, value in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("nbsp", " ")):
        text = text.replace(f"&{name};", value)
    text = re.sub(r"&#(\d{1,9});", lambda m: char(int(m[1])), text)
    text = re.sub(r"&#[xX]([0-9a-fA-F]{1,8});", lambda m: char(int(m[1], 16)), text)
    return text.replace("&amp;", "&").strip()


def _attribute(tag: str, name: str) -> str | None:
    m = re.search(rf"\s{name}\s*=\s*[\"']([^\"']+)[\"']", tag, re.IGNORECASE)
    return m and m[1]


def element(xml: str, *names: str) -> str | None:
    """Text of the first of ``names`` that has any; of an empty element, its url."""
    for name in names:
        tag = re.escape(name)
        if (m := re.search(rf"<{tag}(?:\s[^>]*)?(?<!/)>(.*?)</{tag}>", xml, re.IGNORECASE | re.DOTALL)) and (text := decoded(m[1])):
            return text
        if (m := re.search(rf"<{tag}(?:\s[^>]*)?/>", xml, re.IGNORECASE)) and (url := _attribute(m[0], "url")):
            return decoded(url)
    return None


def linked(xml: str) -> str | None:
    """The alternate HTML link of an entry, else one without relation, else any."""
    tags = [m[0] for m in re.finditer(r"<link\b[^>]*>", xml, re.IGNORECASE) if _attribute(m[0], "href")]
    kinds = [((_attribute(t, "rel") or "").lower(), (_attribute(t, "type") or "html").lower()) for t in tags]
    ranked = sorted(range(len(tags)), key=lambda i: 0 if kinds[i][0] == "alternate" and "html" in kinds[i][1] else 1 if not kinds[i][0] else 2)
    return decoded(_attribute(tags[ranked[0]], "href")) or None if ranked else None


def feed_date(text: str | None) -> int | None:
    """Epoch milliseconds of the dates that feeds give, or None."""
    text = (text or "").strip()
    for read in (lambda: datetime.fromisoformat(text.replace("Z", "+00:00")), lambda: parsedate_to_datetime(text)):
        try:
            at = read()
            return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1000)
        except (ValueError, TypeError, IndexError, OverflowError):
            continue
    return None


def entry(xml: str, atom: bool) -> tuple | None:
    link = (linked(xml) or element(xml, "id")) if atom else (element(xml, "link", "guid") or linked(xml))
    if not link or not re.match(r"https?:", link, re.IGNORECASE):
        return None
    person = re.search(r"<author(?:\s[^>]*)?>(.*?)</author>", xml, re.IGNORECASE | re.DOTALL)
    author = element(xml, "dc:creator") or (person and (element(person[1], "name") or decoded(re.sub(r"<[^>]+>", " ", person[1])))) or None
    inside = [decoded(m[1]) for m in re.finditer(r"<category(?:\s[^>]*)?(?<!/)>(.*?)</category>", xml, re.IGNORECASE | re.DOTALL)]
    terms = [decoded(t) for m in re.finditer(r"<category\b[^>]*>", xml, re.IGNORECASE) if (t := _attribute(m[0], "term"))]
    media = next((u for tag in ("enclosure", "media:content", "media:thumbnail") for m in re.finditer(rf"<{tag}\b[^>]*>", xml, re.IGNORECASE) if (u := _attribute(m[0], "url"))), None)
    return (
        element(xml, "title") or link,
        link,
        element(xml, "description", "summary", "subtitle"),
        element(xml, "content:encoded", "content", "dc:content"),
        author,
        next((d for name in ("pubDate", "published", "dc:date", "updated", "issued") if (d := feed_date(element(xml, name))) is not None), None),
        list(dict.fromkeys(c for c in (*inside, *terms) if c))[:MOST_CATEGORIES],
        media and decoded(media),
    )


def entries(xml: str | None) -> list[tuple]:
    """Entries of a feed of any of the three kinds, 120 at most."""
    xml = xml or ""
    atom = bool(re.search(r"<feed\b", xml, re.IGNORECASE)) and not re.search(r"<(?:rss|rdf:RDF)\b", xml, re.IGNORECASE)
    tag = "entry" if atom else "item"
    parts = re.finditer(rf"<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", xml, re.IGNORECASE | re.DOTALL)
    found = [e for _, m in zip(range(MOST_ENTRIES), parts, strict=False) if (e := entry(m[1], atom))]
    return found


def feed_title(xml: str) -> str:
    head = re.split(r"<(?:item|entry)\b", xml or "", maxsplit=1, flags=re.IGNORECASE)[0]
    return element(head, "title") or ""


@F.udtf(returnType=ENTRY)
class FeedEntries:
    """Table function: the entries of a feed's text."""

    def eval(self, xml: str):
        yield from entries(xml)


def entries_of(feeds: DataFrame) -> DataFrame:
    """path, and the entries of feeds (path, xml), each in one row."""
    spark = feeds.sparkSession
    spark.udtf.register("feed_entries", FeedEntries)
    feeds.createOrReplaceTempView("docloom_feed_files")
    return spark.sql("SELECT f.path, e.* FROM docloom_feed_files f, LATERAL feed_entries(f.xml) e")


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """path, and the entries of every feed file below ``path``."""
    return entries_of(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("xml")))
