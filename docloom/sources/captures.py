"""Captured JSON envelopes and HTML: items wherever in the nesting they are, by table functions and vectorised kernels."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from datetime import datetime
from html.parser import HTMLParser
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import struct

_CAPTURED = (
    "url string, source string, source_id string, kind string, title string, content string, lang string, author_name string, author_handle string, followers long, verified boolean, "
    "likes long, reposts long, replies long, quotes long, bookmarks long, views long, collects long, comments long, media array<string>, published_ms long"
)
CAPTURED = struct(_CAPTURED)
_FIELDS = CAPTURED.fieldNames()
_NOTE_ID = re.compile(r"[0-9a-f]{16,32}", re.IGNORECASE)


def number(value: Any) -> float | None:
    """Numbers that come as numbers or as text: 3,243; 10+; 1.2万; 3亿."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return value
    text = re.sub(r"[,+\s]", "", str(value))
    m = re.fullmatch(r"(\d+(?:\.\d+)?)([万亿]?)", text)
    return round(float(m[1]) * {"": 1, "万": 10_000, "亿": 100_000_000}[m[2]]) if m else None


def compact(text: str | None) -> int | None:
    """1.2K, 3.4M, 5B."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)([KMB]?)", re.sub(r"[,\s]", "", text or "").upper())
    return int(float(m[1]) * {"": 1, "K": 1e3, "M": 1e6, "B": 1e9}[m[2]] + 0.5) if m else None


def walk(root: Any, wanted: Callable[[dict], bool], inside: tuple[str, ...] = (), deepest: int = 14, most: int = 200) -> Iterator[dict]:
    """Objects that ``wanted`` takes, in document order; of a taken one only the ``inside`` children are looked into. Explicit stack: depth is bounded by ``deepest``."""
    stack: list[tuple[Any, int]] = [(root, 0)]
    found = 0
    while stack and found < most:
        node, depth = stack.pop()
        if depth > deepest:
            continue
        if isinstance(node, list):
            stack += [(x, depth + 1) for x in reversed(node)]
        elif isinstance(node, dict):
            if wanted(node):
                found += 1
                yield node
                stack += [(node[k], depth + 1) for k in reversed(inside) if k in node]
            else:
                stack += [(x, depth + 1) for x in reversed(node.values())]


def at(node: Any, *path: str) -> Any:
    for key in path:
        node = node.get(key) if isinstance(node, dict) else None
    return node


def text_at(node: Any, *path: str) -> str | None:
    value = at(node, *path)
    return value if isinstance(value, str) and value else None


def first(*values: Any) -> Any:
    return next((v for v in values if v is not None), None)


def _row(**values: Any) -> tuple:
    whole = lambda v: int(v) if isinstance(v, float) else v
    return tuple(whole(values.get(f)) for f in _FIELDS)


def is_post(node: dict) -> bool:
    return isinstance(at(node, "legacy", "full_text"), str) or isinstance(node.get("full_text"), str) or (node.get("__typename") == "Tweet" and isinstance(node.get("legacy"), dict))


def _named(person: dict) -> tuple[dict, dict, str | None, str | None]:
    """A person, what holds the person's own fields, the handle, and the name."""
    own = person["legacy"] if isinstance(person.get("legacy"), dict) else person
    handle = first(text_at(own, "screen_name"), text_at(person, "core", "screen_name"))
    return person, own, handle, first(text_at(own, "name"), text_at(person, "core", "name"), handle)


def post_row(node: dict) -> tuple | None:
    """A social post: the long body before the short one, links expanded, title from its first telling line."""
    body = node["legacy"] if isinstance(node.get("legacy"), dict) else node
    number_id = first(text_at(body, "id_str"), text_at(node, "rest_id"), text_at(body, "conversation_id_str"))
    text = first(text_at(node, "note_tweet", "note_tweet_results", "result", "text"), text_at(body, "full_text"), text_at(node, "full_text"))
    if not number_id or not (text or "").strip():
        return None
    people = [at(node, "core", "user_results"), at(node, "core", "user_result"), node.get("user_results"), body.get("user"), node.get("user")]
    found = (_named(p.get("result") if isinstance(p.get("result"), dict) else p) for p in people if isinstance(p, dict))
    person, own, handle, name = next((x for x in found if x[2] or x[3]), ({}, {}, None, None))
    for link in at(body, "entities", "urls") or []:
        if text_at(link, "url") and text_at(link, "expanded_url"):
            text = text.replace(link["url"], link["expanded_url"])
    text = re.sub(r"\s*https://t\.co/\w+\s*$", "", text).strip()
    telling = next((x.strip() for x in text.split("\n") if len(x.strip()) > 12), text)
    try:
        published = int(datetime.strptime(text_at(body, "created_at") or "", "%a %b %d %H:%M:%S %z %Y").timestamp() * 1000)
    except ValueError:
        published = None
    thread = body.get("conversation_id_str") == number_id and (number(body.get("reply_count")) or 0) > 0 and len(text) > 400
    media = first(at(body, "extended_entities", "media"), at(body, "entities", "media")) or []
    lang = text_at(body, "lang")
    return _row(
        url=f"https://x.com/{handle or 'i'}/status/{number_id}", source="x", source_id=number_id, kind="thread" if thread else "post", title=telling if len(telling) <= 200 else telling[:197] + "…", content=text, lang=lang if lang != "und" else None,
        author_name=name or handle or "i", author_handle=handle or "i", followers=first(number(own.get("followers_count")), number(person.get("followers_count"))), verified=bool(own.get("verified") is True or person.get("is_blue_verified") is True or at(person, "verification", "verified") is True),
        likes=number(body.get("favorite_count")), reposts=number(body.get("retweet_count")), replies=number(body.get("reply_count")), quotes=number(body.get("quote_count")), bookmarks=number(body.get("bookmark_count")), views=number(at(node, "views", "count")),
        media=[u for m in media[:8] if (u := text_at(m, "media_url_https"))], published_ms=published,
    )


def _note_id(node: dict) -> str | None:
    value = first(node.get("note_id"), node.get("noteId"), node.get("id"))
    return value.lower() if isinstance(value, str) and _NOTE_ID.fullmatch(value) else None


def is_note(node: dict) -> bool:
    return _note_id(node) is not None and (isinstance(node.get("title"), str) or isinstance(node.get("desc"), str) or node.get("type") in ("normal", "video"))


def note_row(node: dict) -> tuple | None:
    title, body = (node.get("title") or "").strip(), (node.get("desc") or "").strip()
    if not title and not body:
        return None
    person = next((node[k] for k in ("user", "author", "userInfo", "user_info") if isinstance(node.get(k), dict)), {})
    name = first(*(text_at(person, k) for k in ("nickname", "nick_name", "name")))
    handle = first(*(text_at(person, k) for k in ("user_id", "userId", "id")))
    counts = next((node[k] for k in ("interact_info", "interactInfo") if isinstance(node.get(k), dict)), node)
    count = lambda *names: number(first(*(counts.get(n) for n in names)))
    when = number(first(*(node.get(k) for k in ("time", "create_time", "createTime", "last_update_time"))))
    images: list[str] = []
    for key in ("cover", "image_list", "imageList", "images"):
        listed = node.get(key)
        for image in listed[:8] if isinstance(listed, list) else [listed]:
            url = image if isinstance(image, str) else first(*(text_at(image, k) for k in ("url", "url_default", "urlDefault")))
            if url and url.startswith("http"):
                images.append(url)
    return _row(
        url=f"https://www.xiaohongshu.com/explore/{_note_id(node)}", source="xiaohongshu", source_id=_note_id(node), kind="video" if node.get("type") == "video" else "note", title=(title or body.split("\n")[0])[:300], content="\n\n".join(x for x in (title, body) if x), lang="zh",
        author_name=name or handle, author_handle=handle, likes=count("liked_count", "likedCount", "likes"), collects=count("collected_count", "collectedCount", "collects"), comments=count("comment_count", "commentCount", "comments"), reposts=count("share_count", "shareCount", "shares"), views=count("view_count", "viewCount"),
        media=images[:8], published_ms=(when * 1000 if when < 1e12 else when) if when else None,
    )


def captured(payload: str | None, wanted: Callable, row: Callable, inside: tuple[str, ...], deepest: int, most: int) -> list[tuple]:
    """Rows of a JSON text, the first of each URL; none if it is no JSON."""
    try:
        root = json.loads(payload or "")
    except ValueError:
        return []
    rows = (r for n in walk(root, wanted, inside, deepest, 2 * most) if (r := row(n)))
    return list({r[0]: r for r in reversed(list(rows))}.values())[::-1][:most]


def posts(payload: str | None) -> list[tuple]:
    return captured(payload, is_post, post_row, ("quoted_status_result", "retweeted_status_result"), 14, 120)


def notes(payload: str | None) -> list[tuple]:
    return captured(payload, is_note, note_row, (), 12, 80)


@F.udtf(returnType=CAPTURED)
class CapturedPosts:
    def eval(self, payload: str):
        yield from posts(payload)


@F.udtf(returnType=CAPTURED)
class CapturedNotes:
    def eval(self, payload: str):
        yield from notes(payload)


def from_captures(captures: DataFrame, payload_col: str, kind: str) -> DataFrame:
    """The rows of ``captures`` with what their JSON holds: posts or notes."""
    spark = captures.sparkSession
    spark.udtf.register("captured_rows", {"posts": CapturedPosts, "notes": CapturedNotes}[kind])
    captures.createOrReplaceTempView("docloom_captures")
    return spark.sql(f"SELECT c.*, r.* FROM docloom_captures c, LATERAL captured_rows(c.`{payload_col}`) r")


class _Cards(HTMLParser):
    """Elements that ``opens`` takes, each with its links, times, images, and the texts of marked parts inside it."""

    def __init__(self, opens: Callable[[str, dict], bool]) -> None:
        super().__init__(convert_charrefs=True)
        self.opens, self.cards, self.stack = opens, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        card = next((s[1] for s in reversed(self.stack) if s[1]), None)
        if card is None and self.opens(tag, a):
            card = {"links": [], "times": [], "images": [], "labels": {}, "texts": {}}
            self.cards.append(card)
        mark = a.get("data-testid") or a.get("class", "").split(" ")[0]
        if card is not None:
            for kind, name in (("links", "href"), ("times", "datetime"), ("images", "src")):
                if a.get(name):
                    card[kind].append(a[name])
            if mark and a.get("aria-label"):
                card["labels"].setdefault(mark, a["aria-label"])
        if tag not in ("br", "img", "input", "hr", "meta", "link", "source"):
            self.stack.append((tag, card, mark))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        for mark, card in {(m, id(c)): (m, c) for _, c, m in self.stack if c is not None and m}.values():
            card["texts"][mark] = card["texts"].get(mark, "") + data


def cards(html: str | None, opens: Callable[[str, dict], bool]) -> list[dict]:
    parser = _Cards(opens)
    parser.feed(html or "")
    parser.close()
    return parser.cards


def posts_of_page(html: str | None, most: int = 60) -> list[tuple]:
    """Posts of a rendered page: identity by the permalink, counts by their labels; the first of each URL."""
    out: dict[str, tuple] = {}
    for c in cards(html, lambda tag, a: tag == "article" and (a.get("data-testid") == "tweet" or a.get("role") == "article")):
        link = next((m for h in c["links"] if "/analytics" not in h and (m := re.match(r"/(\w{1,20})/status/(\d+)", h, re.ASCII))), None)
        body = c["texts"].get("tweetText", "").strip()
        if not link or not body or len(out) >= most:
            continue
        count = lambda mark, c=c: compact((re.search(r"[\d.,]+[KMB]?", c["labels"].get(mark) or c["texts"].get(mark, "")) or [None])[0])
        url = f"https://x.com/{link[1]}/status/{link[2]}"
        telling = next((x.strip() for x in body.split("\n") if len(x.strip()) > 12), body)
        out.setdefault(url, _row(url=url, source="x", source_id=link[2], kind="post", title=telling[:200], content=body, author_name=c["texts"].get("User-Name", "").split("@")[0].strip() or link[1], author_handle=link[1], likes=count("like"), reposts=count("retweet"), replies=count("reply"), media=[i for i in c["images"] if "twimg.com" in i][:4], published_ms=_iso(c["times"])))
    return list(out.values())


def notes_of_page(html: str | None, most: int = 60) -> list[tuple]:
    """Notes of a rendered page: an open note's card, with its text, replaces the stub of the grid."""
    out: dict[str, tuple] = {}
    for c in cards(html, lambda tag, a: "note-item" in a.get("class", "") or "note-container" in a.get("class", "")):
        link = next((m for h in c["links"] if (m := re.search(r"/(?:explore|discovery/item)/([0-9a-fA-F]{16,32})", h))), None)
        title, body = c["texts"].get("title", "").strip(), c["texts"].get("desc", "").strip()
        if not link or not (title or body):
            continue
        url = f"https://www.xiaohongshu.com/explore/{link[1].lower()}"
        row = _row(url=url, source="xiaohongshu", source_id=link[1].lower(), kind="note", title=(title or body)[:300], content="\n\n".join(x for x in (title, body) if x), lang="zh", author_name=c["texts"].get("author", c["texts"].get("name", "")).strip() or None, likes=number(c["texts"].get("count")), media=[i for i in c["images"] if i.startswith("http")][:8])
        if url not in out or (body and len(row[5]) > len(out[url][5] or "")):
            out[url] = row
    return list(out.values())[:most]


def _iso(times: list[str]) -> int | None:
    try:
        return int(datetime.fromisoformat(times[0].replace("Z", "+00:00")).timestamp() * 1000) if times else None
    except ValueError:
        return None


# Weights of page containers.
_GOOD = re.compile(r"article|content|post|entry|main|body|story|text|markdown", re.IGNORECASE)
_BAD = re.compile(r"comment|nav|footer|header|sidebar|menu|promo|related|share|ad-|advert|cookie|banner|modal", re.IGNORECASE)
LINK_COST, BAD_FACTOR, GOOD_FACTOR, ARTICLE_FACTOR, MAIN_FACTOR, PARAGRAPH, MOST_PARAGRAPHS, DEEP_FACTOR, DEEP = 1.4, 0.15, 1.6, 2.2, 1.8, 22, 40, 0.85, 14
ARTICLE = struct("title string, author string, published string, description string, image string, content string")


class _Page(HTMLParser):
    """Meta data, JSON-LD, and per container its text, link text and paragraphs."""

    BOXES = ("article", "main", "section", "div", "body", "td")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.linked_data: list[str] = []
        self.stack: list[str] = []
        self.boxes: list[dict] = []
        self.open: list[dict] = []
        self.title, self.heading, self.skip, self.links = "", "", 0, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            if name := a.get("property") or a.get("name") or a.get("itemprop"):
                self.meta.setdefault(name.lower(), a.get("content", "").strip())
            return
        if tag in ("br", "hr", "img", "input", "link"):
            return
        self.stack.append(tag)
        if tag in ("script", "style", "noscript", "nav", "aside", "footer", "form"):
            self.skip += 1
        self.links += tag == "a"
        if tag in self.BOXES:
            box = {"tag": tag, "name": f"{a.get('class', '')} {a.get('id', '')}", "depth": len(self.stack), "text": 0, "link": 0, "p": 0, "parts": []}
            self.open.append(box)
            self.boxes.append(box)
        self.json = tag == "script" and "ld+json" in a.get("type", "")
        if tag in ("p", "li", "h1", "h2", "h3", "h4", "pre", "blockquote"):
            mark = {"li": "\n- ", "h1": "\n\n# ", "h2": "\n\n## ", "h3": "\n\n### ", "h4": "\n\n#### "}.get(tag, "\n\n")
            for box in self.open:
                box["p"] += tag == "p"
                box["parts"].append(mark)

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.stack:
            return
        while self.stack:
            closed = self.stack.pop()
            if closed in ("script", "style", "noscript", "nav", "aside", "footer", "form"):
                self.skip -= 1
            self.links -= closed == "a"
            if closed in self.BOXES and self.open:
                self.open.pop()
            if closed == tag:
                break

    def handle_data(self, data: str) -> None:
        top = self.stack[-1] if self.stack else ""
        if top == "script" and getattr(self, "json", False):
            self.linked_data.append(data)
        if top == "title":
            self.title += data
        if top == "h1" and not self.heading:
            self.heading = data.strip()
        if self.skip:
            return
        text = re.sub(r"\s+", " ", data)
        for box in self.open:
            box["text"] += len(text.strip())
            box["link"] += len(text.strip()) if self.links else 0
            box["parts"].append(text)


def _box_score(box: dict) -> float:
    score = box["text"] - LINK_COST * box["link"]
    score *= BAD_FACTOR if _BAD.search(box["name"]) else 1
    score *= GOOD_FACTOR if _GOOD.search(box["name"]) else 1
    score *= {"article": ARTICLE_FACTOR, "main": MAIN_FACTOR}.get(box["tag"], 1)
    return (score + PARAGRAPH * min(box["p"], MOST_PARAGRAPHS)) * (DEEP_FACTOR if box["depth"] > DEEP else 1)


def article(html: str | None) -> dict:
    """Title, author, date, description, image (linked data before meta data before the page itself) and the text of the best container."""
    page = _Page()
    page.feed(html or "")
    page.close()
    data: dict = {}
    for text in page.linked_data:
        try:
            root = json.loads(text)
        except ValueError:
            continue
        nodes = root if isinstance(root, list) else at(root, "@graph") or [root]
        data = next((n for n in nodes if isinstance(n, dict) and "Article" in str(n.get("@type"))), data)
    who = data.get("author")
    who = who[0] if isinstance(who, list) and who else who
    meta = lambda *names: next((page.meta[n] for n in names if page.meta.get(n)), None)
    best = max(page.boxes, key=_box_score, default=None)
    content = re.sub(r" *\n *", "\n", re.sub(r"\n{3,}", "\n\n", "".join(best["parts"]))).strip() if best else ""
    return {
        "title": text_at(data, "headline") or meta("og:title", "twitter:title") or page.heading or page.title.strip() or None,
        "author": (who.get("name") if isinstance(who, dict) else who) or meta("author", "article:author", "twitter:creator"),
        "published": text_at(data, "datePublished") or meta("article:published_time", "date", "datepublished"),
        "description": text_at(data, "description") or meta("og:description", "description"),
        "image": meta("og:image", "twitter:image"),
        "content": content,
    }


@F.pandas_udf(ARTICLE)
def captured_article(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([article(p) for p in pages], columns=ARTICLE.fieldNames(), dtype=object)
