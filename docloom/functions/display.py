"""Numbers, times and labels for people, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import half_up

# Names of sources and kinds.
SOURCE_LABELS = {"x": "X", "xiaohongshu": "Xiaohongshu", "hackernews": "Hacker News", "arxiv": "arXiv", "github": "GitHub", "reddit": "Reddit", "youtube": "YouTube", "producthunt": "Product Hunt", "huggingface": "Hugging Face", "rss": "RSS", "web": "Web", "manual": "Manual"}
KIND_LABELS = {k: k.capitalize() for k in ("post", "thread", "note", "article", "paper", "repo", "release", "video", "discussion", "link")}


def labelled(c: Column, labels: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))[c], c)


def _tenths(v: Column) -> Column:
    """A double from 1 up to 10, of either sign, with one decimal place, as C's printf rounds: by its exact binary value, a tie to the even digit. Spark's own formats round the shortest decimal, 1.15 to 1.2.

    52 bits after the point hold such a double exactly, so it is rounded as an integer of 64 bits.
    """
    x = F.floor(F.abs(v) * 2.0**52) * 10
    down, rest, half = F.shiftright(x, 52), x.bitwiseAND(F.lit((1 << 52) - 1)), F.lit(1 << 51)
    n = down + F.when((rest > half) | ((rest == half) & (down % 2 == 1)), 1).otherwise(0)
    return F.concat(F.when(v < 0, "-").otherwise(""), F.floor(n / 10).cast("string"), F.when(n % 10 == 0, "").otherwise(F.concat(F.lit("."), (n % 10).cast("string"))))


def compact_number(n: Column) -> Column:
    """950, 1.5K, 15K, 3.4M, 2B; a dash for null."""
    n = n.cast("double")

    def scaled(unit: float, suffix: str) -> Column:
        v = n / unit
        text = F.when(F.abs(v) >= 10, half_up(v).cast("string")).otherwise(_tenths(v))
        return F.concat(text, F.lit(suffix))

    return F.when(n.isNull(), "—").when(F.abs(n) < 1e3, half_up(n).cast("string")).when(F.abs(n) < 1e6, scaled(1e3, "K")).when(F.abs(n) < 1e9, scaled(1e6, "M")).otherwise(scaled(1e9, "B"))


def time_ago(at_ms: Column, now_ms: Column, locale: str = "en") -> Column:
    """now, 5m, 3h, 2d, 3w, 4mo, 1y, from epoch milliseconds."""
    s = F.greatest(F.lit(0), half_up((now_ms - at_ms) / 1000))
    steps = ((60, "s", "秒前"), (3600, "m", "分钟前"), (86400, "h", "小时前"), (7 * 86400, "d", "天前"), (30 * 86400, "w", "周前"), (365 * 86400, "mo", "个月前"), (None, "y", "年前"))
    units = (1, 60, 3600, 86400, 7 * 86400, 30 * 86400, 365 * 86400)
    out = F.when(s < 45, "now" if locale == "en" else "刚刚")
    for (limit, en, zh), unit in zip(steps, units, strict=True):
        text = F.concat(half_up(s / unit).cast("string"), F.lit(en if locale == "en" else zh))
        out = out.when(s < limit, text) if limit else out.otherwise(text)
    return out


def format_duration(seconds: Column) -> Column:
    """45s, 3m, 2h 5m."""
    s = half_up(seconds.cast("double"))
    hours, minutes = F.floor(s / 3600), half_up((s % 3600) / 60)
    long = F.when(minutes == 0, F.format_string("%dh", hours)).otherwise(F.format_string("%dh %dm", hours, minutes))
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm", half_up(s / 60))).otherwise(long)


def format_bytes(n: Column) -> Column:
    n = n.cast("double")
    out = F.when(n < 1024, F.format_string("%d B", n.cast("long")))
    for power, unit in ((1, "KB"), (2, "MB")):
        out = out.when(n < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", n / 1024**power))
    return out.otherwise(F.format_string("%.1f GB", n / 1024**3))


def initials(name: Column) -> Column:
    """First letters of the first and last word; a CJK name gives its first character."""
    words = F.filter(F.split(F.trim(F.coalesce(name, F.lit(""))), r"\s+"), lambda w: w != "")
    first, last = F.substring(F.get(words, F.lit(0)), 1, 1), F.substring(F.element_at(words, -1), 1, 1)
    return F.when(F.size(words) == 0, "?").when(F.size(words) == 1, F.upper(first)).otherwise(F.upper(F.concat(first, last)))


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "critical").when(score >= 62, "high").when(score >= 40, "medium").otherwise("low")


def string_hue(c: Column) -> Column:
    """A colour of a string: 32-bit FNV-1a over its bytes, modulo 360."""
    prime, mask = 16777619, 0xFFFFFFFF
    codes = F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    # (h xor code) * prime stays below 2**57, so 64-bit arithmetic holds it before the mask.
    return (F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * prime).bitwiseAND(F.lit(mask).cast("long"))) % 360).cast("int")


def format_datetime(at_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(at_ms), "yyyy-MM-dd HH:mm")


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {word}").otherwise(f" {word}s"))
