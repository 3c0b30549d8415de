"""Digests from templates: the best items of a period, capped by author, clustered by topic."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import excerpt
from ..operators.filters import when_ms
from ..operators.ranking import capped
from ..schema import DIGEST

HOUR_MS = 3_600_000
CLUSTERS, BULLETS, MERGE_COSINE = 5, 4, 0.45


def select_items(items: DataFrame, now_ms: int, hours: int = 24, most: int = 24, per_author: int = 2) -> DataFrame:
    """The period's best canonical items, at most two an author (handle, else name, else source)."""
    fits = items.filter("duplicate_of is null and state <> 'trash'").filter((when_ms() >= now_ms - hours * HOUR_MS) & (when_ms() <= now_ms))
    best = fits.orderBy(F.desc("score"), "id").limit(4 * most)
    return capped(best, F.coalesce("author.handle", "author.name", "source"), [F.desc("score"), F.asc("id")], per_author, most)


def cluster(rows: list) -> list[tuple[str, list]]:
    """A bounded list of items by first topic; lone ones join the larger cluster they are most like; the five largest."""
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault((r["topics"] or ["other"])[0], []).append(r)
    unit = lambda v: np.asarray(v, float) / (np.linalg.norm(v) or 1)
    for topic in [t for t, g in groups.items() if len(g) == 1]:
        own = groups[topic][0]
        if own["embedding"] is None:
            continue
        likeness = {t: max((float(unit(own["embedding"]) @ unit(r["embedding"])) for r in g if r["embedding"] is not None), default=0.0) for t, g in groups.items() if len(g) > 1}
        best = max(likeness, key=likeness.get, default=None)
        if best is not None and likeness[best] > MERGE_COSINE:
            groups[best] += groups.pop(topic)
    return sorted(groups.items(), key=lambda g: (-len(g[1]), -max(r["score"] or 0 for r in g[1]), g[0]))[:CLUSTERS]


def template(rows: list) -> str:
    """The digest's text: a lede and up to four bullets a section."""
    if not rows:
        return "No items in this period."
    groups = cluster(rows)
    sources = len({r["source"] for r in rows})
    lines = [f"{len(rows)} items from {sources} source{'s' if sources != 1 else ''}, in {len(groups)} theme{'s' if len(groups) != 1 else ''}."]
    top = max(rows, key=lambda r: (r["score"] or 0, r["id"]))
    lines[0] += f" Best: {top['title'] or top['url']}" + (f", by {top['by']}." if top["by"] else ".")
    number = {r["id"]: i + 1 for i, r in enumerate(rows)}
    for topic, group in groups:
        lines += ["", f"## {topic}"] + [f"- {r['title'] or r['url']}: {r['line']} [{number[r['id']]}]" for r in sorted(group, key=lambda r: (-(r["score"] or 0), r["id"]))[:BULLETS]]
    return "\n".join(lines)


def generate(items: DataFrame, now_ms: int, hours: int = 24, most: int = 24) -> DataFrame:
    """One row of the digest table."""
    chosen = select_items(items, now_ms, hours, most).withColumn("line", excerpt(F.coalesce("summary", "content"), 160))
    by = F.coalesce("author.name", "author.handle").alias("by")
    rows = chosen.select("id", "url", "title", "source", "topics", "score", "embedding", "line", by).collect()  # ``most`` rows
    name = "Daily" if hours <= 24 else "Weekly" if hours <= 168 else "Period"
    body = template(rows)
    key = hashlib.sha256(f"{now_ms}:{hours}:{body}".encode()).hexdigest()[:24]
    return items.sparkSession.createDataFrame([(key, f"{name} digest", now_ms - hours * HOUR_MS, now_ms, body, [r["id"] for r in rows], now_ms)], DIGEST)


def stored(digests: DataFrame, digest_id: str | None = None, limit: int = 30) -> DataFrame:
    """Digests, latest first; or one by its identifier. ``stored(digests, limit=1)`` is the latest."""
    if digest_id is not None:
        return digests.filter(F.col("id") == digest_id)
    return digests.orderBy(F.desc("period_to_ms"), F.desc("created_ms"), "id").limit(limit)


def sections(body: str) -> list[dict]:
    """Headings, text and cited numbers of a Markdown digest."""
    import re

    out = []
    for part in re.split(r"(?m)^## +", body)[1:]:
        head, _, rest = part.partition("\n")
        out.append({"heading": head.strip(), "body": rest.strip(), "cited": [int(n) for n in dict.fromkeys(re.findall(r"\[(\d+)\]", rest))]})
    return out


def is_due(last_ms: int | None, now_ms: int, hour: int) -> bool:
    """Once a UTC day after ``hour``."""
    day, at = divmod(now_ms, 24 * HOUR_MS)
    return at >= hour * HOUR_MS and (last_ms is None or last_ms // (24 * HOUR_MS) < day)
