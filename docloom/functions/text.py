"""Text functions as Column expressions; they stay in the JVM, except the numeric character references of ``html_to_text``.

Lengths are code points. Latin word edges are ASCII (``WORD_START``, ``WORD_END``), so a Latin word next to a CJK character still counts as one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges of CJK characters; runs leave out punctuation and full-width forms.
CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿　-〿＀-￯가-힯"
CJK_RUN = "぀-ヿ㐀-䶿一-鿿豈-﫿가-힯"
LATIN_TOKEN = "[a-z0-9][a-z0-9+#._-]{0,38}"
WORD_START, WORD_END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

# English stop words that a Latin token can be (a token has no apostrophe).
STOPWORDS_EN = frozenset(
    """a about above after again against all am an and any are as at be because been before being below between both but by can cannot could did do does doing down during each
    few for from further had has have having he her here hers herself him himself his how i if in into is it its itself let me more most my myself no nor not of off on once only or other ought our
    ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where
    which while who whom why with would you your yours yourself yourselves just like really new via using use used get got make makes made one two also now still even much many way lot thing things
    something anything everything amp rt http https www com html pdf thread""".split()
)
# Chinese stop words.
STOPWORDS_ZH = frozenset(
    """的 了 是 在 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 那 我们 他们 你们 但是 因为 所以 如果 可以 这个 那个 什么 怎么 为什么 已经 还是 或者 而且 不过 然后 现在
    以及 通过 对于 关于 进行 实现 提供 支持 需要 能够 一些 这些 那些 时候 问题 方式 方法 情况 内容 分享 大家 真的 感觉 觉得 其实 就是 一下 特别 非常 直接 之后 之前 一直 目前 主要 包括""".split()
)
# Engagement-bait patterns, weights and labels, in order of report.
NOISE_PATTERNS = (
    (rf"(?i){WORD_START}(?:follow|rt|retweet|like)\s+(?:me|this|and){WORD_END}", 0.30, "follow-bait"),
    (rf"(?i){WORD_START}(?:giveaway|free\s+course|dm\s+me|link\s+in\s+bio|comment\s+[\"“]?\w+[\"”]?\s+and){WORD_END}", 0.35, "giveaway"),
    (rf"(?i){WORD_START}\d+\s+(?:tips|hacks|tools|prompts|secrets|tricks|ways)\s+(?:to|that|you){WORD_END}", 0.18, "listicle-bait"),
    (rf"(?i){WORD_START}(?:this\s+will\s+blow\s+your\s+mind|nobody\s+is\s+talking\s+about|game\s?changer|insane|mind[-\s]?blowing){WORD_END}", 0.22, "hype"),
    (rf"(?i){WORD_START}(?:you'?re\s+doing\s+it\s+wrong|stop\s+using|delete\s+your){WORD_END}", 0.12, "provocation"),
    ("一定要看|震惊|你不知道的|干货满满|速看|保姆级|建议收藏|抓紧|绝了|太香了", 0.20, "zh-hype"),
    (r"(?i)^\s*(?:🧵|thread\s*:|a\s+thread)", 0.05, "thread-marker"),
)
# Markers of substance and their weights.
DEPTH_MARKERS = (
    (r"```|\n\s{4}\S|`[^`]{6,}`", 0.14),
    (rf"(?i){WORD_START}arxiv\.org/abs/|{WORD_START}doi\.org/|\[\d+\]\s", 0.13),
    (rf"(?i){WORD_START}github\.com/[\w.-]+/[\w.-]+", 0.09),
    (rf"(?i){WORD_START}\d+(?:\.\d+)?\s*(?:%|x{WORD_END}|tok/s|tokens/s|ms{WORD_END}|GB{WORD_END}|B params|M params|FLOPs)", 0.12),
    (rf"(?i){WORD_START}(?:we (?:trained|measured|evaluated|found|built)|benchmark(?:ed)?|ablation|methodology|reproduc)", 0.11),
    (rf"(?i){WORD_START}(?:however|whereas|trade-?off|caveat|limitation|counterintuitive|nuance)", 0.08),
    ("实测|复现|对比实验|消融|参数量|吞吐|延迟|开源地址", 0.11),
)
# Elements that break lines.
BLOCK_ELEMENTS = "p|div|section|article|header|footer|main|aside|nav|h[1-6]|ul|ol|li|blockquote|pre|table|tr|br|hr|figure|figcaption"


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def found(c: Column, pattern: str) -> Column:
    """All matches of a pattern without groups."""
    return F.regexp_extract_all(text_of(c), F.lit(pattern), F.lit(0))


def counted(c: Column, pattern: str) -> Column:
    return F.regexp_count(text_of(c), F.lit(pattern))


def half_up(c: Column) -> Column:
    """Rounding of halves towards infinity."""
    return F.floor(c + 0.5)


def has_cjk(c: Column) -> Column:
    return text_of(c).rlike(f"[{CJK}]")


def cjk_bigrams(c: Column) -> Column:
    """Neighbouring pairs of every CJK run; a run of one character stays whole. A lookahead matches at every place, so pairs overlap."""
    return F.regexp_extract_all(text_of(c), F.lit(f"(?=([{CJK_RUN}]{{2}}|(?<![{CJK_RUN}])[{CJK_RUN}](?![{CJK_RUN}])))"), F.lit(1))


def tokenize(c: Column, keep_stopwords: bool = False, stopwords: Iterable[str] = STOPWORDS_EN, stopwords_zh: Iterable[str] = STOPWORDS_ZH) -> Column:
    """Lower-case Latin tokens of two characters or more, then CJK pairs; stop words go unless kept."""
    latin = F.filter(found(F.lower(c), LATIN_TOKEN), lambda t: F.length(t) >= 2)
    pairs = F.when(has_cjk(c), cjk_bigrams(F.lower(c))).otherwise(F.array().cast("array<string>"))  # trying a pair at every place is slow
    if keep_stopwords:
        return F.concat(latin, pairs)
    # A long list of literals becomes a hash set.
    return F.concat(F.filter(latin, lambda t: ~t.isin(*sorted(stopwords))), F.filter(pairs, lambda t: ~t.isin(*sorted(stopwords_zh))))


def detect_lang(c: Column) -> Column:
    """Language by script shares of the first 2000 characters."""
    head = F.substring(text_of(c), 1, 2000)
    stripped = F.regexp_replace(head, r"\s", "")
    total = F.greatest(F.length(stripped), F.lit(1))
    share = lambda chars: counted(stripped, f"[{chars}]") / total
    return (
        F.when(F.length(stripped) == 0, "und")
        .when(share("぀-ヿ") > 0.08, "ja")
        .when(share("가-힯") > 0.15, "ko")
        .when(share("一-鿿㐀-䶿") > 0.15, "zh")
        .when(share("Ѐ-ӿ") > 0.3, "ru")
        .when(share("A-Za-z") > 0.4, "en")
        .otherwise("und")
    )


def reading_time_sec(c: Column) -> Column:
    """238 Latin words or 400 CJK characters a minute; at least 5 seconds for any text."""
    cjk = counted(c, f"[{CJK_RUN}]")
    words = counted(F.regexp_replace(text_of(c), f"[{CJK_RUN}]+", " "), r"\S+")
    return F.greatest(F.when(F.trim(text_of(c)) != "", 5).otherwise(0), half_up(words / 238 * 60 + cjk / 400 * 60)).cast("int")


def _references(c: Column) -> Column:
    """Decimal and hexadecimal character references, which only Python decodes; texts without any never leave the JVM."""
    @F.pandas_udf("string")
    def decode(texts: pd.Series) -> pd.Series:
        char = lambda n: chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else "�"
        return texts.str.replace(r"&#(\d{1,8});", lambda m: char(int(m[1])), regex=True).str.replace(r"&#[xX]([0-9a-fA-F]{1,6});", lambda m: char(int(m[1], 16)), regex=True)

    return decode(c)


def html_to_text(c: Column, numeric_references: bool = False) -> Column:
    """Readable text of HTML: scripts, styles and comments go, block elements break lines, other tags go, references are decoded (numeric ones only if asked for)."""
    out = text_of(c)
    for pattern in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?is)<noscript\b.*?</noscript>", r"(?s)<!--.*?-->"):
        out = F.regexp_replace(out, pattern, " ")
    out = F.regexp_replace(out, rf"(?i)</?(?:{BLOCK_ELEMENTS})\b[^>]*>", "\n")
    out = F.regexp_replace(out, "<[^>]+>", "")
    # The named references.
    for name, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–")):
        out = F.replace(out, F.lit(name), F.lit(char))
    out = _references(out) if numeric_references else out
    out = F.regexp_replace(out, "[ \t ]+", " ")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(out, r"(?m)^[^\S\n]+|[^\S\n]+$", ""), r"^\s+|\s+$", "")


def normalise_text(c: Column, limit: int = 200_000) -> Column:
    """Text of what looks like HTML, trimmed and cut to ``limit``."""
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.substring(F.when(text_of(c).rlike(r"(?i)<[a-z][\s\S]*>"), html_to_text(c, numeric_references=True)).otherwise(trimmed(text_of(c))), 1, limit)


def truncate(c: Column, limit: int, ellipsis: str = "…") -> Column:
    """At most ``limit`` characters and an ellipsis, cut at the last space if that leaves over 60 %."""
    text = text_of(c)
    head = F.substring(text, 1, limit)
    space = F.length(head) - F.instr(F.reverse(head), " ")  # characters before the last space
    cut = F.when(has_cjk(head), head).when((F.instr(head, " ") > 0) & (space > limit * 0.6), F.substring(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(cut, r"\s+$", ""), F.lit(ellipsis)))


def excerpt(c: Column, limit: int = 220) -> Column:
    """Plain text of Markdown on one line, truncated."""
    out = text_of(c)
    # The marks of Markdown.
    for pattern, new in ((r"(?m)^#{1,6}\s+", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"[*_`>]", ""), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, new)
    return truncate(F.trim(out), limit)


def snippet(c: Column, terms: list[str], radius: int = 120) -> Column:
    """The text around the first hit of any term; without a hit, an excerpt."""
    text = text_of(c)
    places = [F.nullif(F.locate(t.lower(), F.lower(text)), F.lit(0)) for t in terms if t]
    at = (F.least(*places) if len(places) > 1 else places[0] if places else F.lit(None).cast("int")) - 1
    start, end = F.greatest(F.lit(0), at - radius), F.least(F.length(text), at + radius)
    body = F.trim(F.regexp_replace(F.substring(text, start + 1, end - start), r"\s+", " "))
    around = F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(end < F.length(text), "…").otherwise(""))
    return F.when(at.isNull(), excerpt(c, 2 * radius)).otherwise(around)


def highlighted(c: Column, terms: list[str], before: str = "<mark>", after: str = "</mark>") -> Column:
    """The text with every term marked, longest first."""
    pattern = "|".join(re.escape(t) for t in sorted({t for t in terms if t}, key=lambda t: (-len(t), t)))
    return F.regexp_replace(text_of(c), f"(?i)({pattern})", f"{before}$1{after}") if pattern else text_of(c)


def noise(c: Column) -> Column:
    """score (0 to 1) and reasons of engagement bait in the first 4000 characters."""
    head = F.substring(text_of(c), 1, 4000)
    emoji = counted(head, "[\U0001f300-\U0001faff☀-➿]") / F.greatest(F.length(head), F.lit(1))
    tags, letters, marks = counted(head, r"#[^\s#]+"), counted(head, "[A-Za-z]"), counted(head, "[!！]")
    shouting = (letters > 30) & (counted(head, "[A-Z]") / F.greatest(letters, F.lit(1)) > 0.55)
    hits = [(head.rlike(p), F.lit(w), label) for p, w, label in NOISE_PATTERNS]
    hits += [(emoji > 0.035, F.least(F.lit(0.2), (emoji - 0.035) * 4), "emoji-dense"), (tags >= 6, F.least(F.lit(0.2), (tags - 5) * 0.03), "hashtag-stuffing")]
    hits += [(shouting, F.lit(0.12), "shouting"), (marks >= 5, F.least(F.lit(0.1), marks * 0.015), "exclamatory")]
    score = reduce(lambda a, b: a + b, (F.when(hit, weight).otherwise(0.0) for hit, weight, _ in hits))
    return F.struct(F.least(F.lit(1.0), score).alias("score"), F.array_compact(F.array(*(F.when(hit, label) for hit, _, label in hits))).alias("reasons"))


def weighed_terms(tokens: object, limit: int) -> list[tuple[str, float]]:
    """The best of a token list: frequency, early first use and length count; the best has weight 1."""
    n = 0 if tokens is None else len(tokens)
    first: dict[str, int] = {}
    count: dict[str, int] = {}
    for i, t in enumerate(tokens if n else ()):
        first.setdefault(t, i)
        count[t] = count.get(t, 0) + 1
    weighed = sorted(((k / n * (1 - first[t] / n * 0.45) * (1.15 if len(t) >= 6 else 1.0) * math.log1p(k), t) for t, k in count.items()), key=lambda x: -x[0])
    top = weighed[0][0] if weighed else 0
    return [(t, w / top if top else 0.0) for w, t in weighed[:limit]]


def keywords(c: Column, limit: int = 12) -> Column:
    """term and weight of the best terms.

    Counting within one row takes a hash table, which array functions lack: a vectorised kernel over the native tokens. Over a table, ``operators.terms.keyword_table`` is native throughout.
    """

    @F.pandas_udf("array<struct<term:string,weight:double>>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda tokens: [{"term": t, "weight": w} for t, w in weighed_terms(tokens, limit)])

    return run(tokenize(c))


def summary_of(body: str, tokens: object, sentences: int) -> str:
    parts = [p.strip() for p in re.split(r"(?<=[.!?。！？])\s+|\n+", body)]
    parts = [p for p in parts if len(p) > 30][:40]
    terms = weighed_terms(tokens, 30)
    score = [sum(w for t, w in terms if t in p.lower()) * (1 - 0.015 * i) * (1.15 if re.search(r"\d", p) else 1.0) for i, p in enumerate(parts)]
    best = sorted(sorted(range(len(parts)), key=lambda i: -score[i])[:sentences])
    return " ".join(parts[i] for i in best)


def extractive_summary(c: Column, sentences: int = 3) -> Column:
    """The sentences (of the first 40 over 30 characters) that hold the heaviest keywords, in their order."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series([summary_of(t, k, sentences) for t, k in zip(texts, rows, strict=True)], dtype="object")

    return run(text_of(c), tokenize(c))


def takeaways(c: Column, limit: int = 5) -> Column:
    """Bulleted lines of 8 to 240 characters."""
    lines = F.transform(F.split(text_of(c), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    return F.slice(F.filter(lines, lambda x: F.length(x).between(8, 240)), 1, limit)


def slugify(c: Column, limit: int = 80) -> Column:
    """Lower-case words joined by hyphens; CJK characters stay."""
    out = F.regexp_replace(F.lower(F.trim(text_of(c))), f"[^a-z0-9{CJK_RUN}]+", "-")
    return F.substring(F.regexp_replace(out, "^-+|-+$", ""), 1, limit)


def parse_compact(c: Column) -> Column:
    """1.2K, 3.4M, 5B, 1,234 as numbers; 1.2万 and 3亿 too; a trailing plus is ignored; anything else is null."""
    text = F.regexp_replace(F.trim(text_of(c)), "[,+\\s]", "")
    number = F.try_to_number(F.regexp_extract(text, r"^(\d+(?:\.\d+)?)", 1), F.lit("999999999999.999999"))
    unit = F.lower(F.regexp_extract(text, r"^\d+(?:\.\d+)?([kKmMbBwW万亿]?)$", 1))
    factor = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).when(unit.isin("w", "万"), 1e4).when(unit == "亿", 1e8).otherwise(1.0)
    return F.when(text.rlike(r"^\d+(?:\.\d+)?[kKmMbBwW万亿]?$"), half_up(number.cast("double") * factor)).cast("long")
