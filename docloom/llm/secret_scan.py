"""Secrets in texts: assignments, access keys and hexadecimal runs by pattern, and random strings by token efficiency.

A byte-pair vocabulary spends few tokens on what people write and many on random strings, so few characters a token expose what no pattern names.

Nulls: a null text is empty, a null key stays null. Repeated rows and keys are scanned row by row; other columns, whatever their names, are left out. An empty table gives no rows. Texts are scanned whole,
in time linear in their length: a run of any length is encoded in pieces of ``PIECE`` characters, whose tokens are added up.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import column, keyed_text, small_batches

#: The kinds in their order, and the patterns of the first three.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run, as shorter runs don't count
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

#: Runs of sixteen characters or more of the alphabets that keys are written in; hexadecimal runs lie within them.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Identifiers and digests that are no secrets: UUIDs, ULIDs, digests in hexadecimal by their lengths, digests after the name of their algorithm, dates and times.
KNOWN = re.compile(
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-7][0-9A-HJKMNP-TV-Z]{25}|(?:[0-9A-Fa-f]{24}|[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{128})"
    r"|(?:md5|sha1|sha224|sha256|sha384|sha512)[-=_/]\S+|\d{4}-?\d\d-?\d\d(?:T\S*)?"
)
PIECE = 256
#: Characters a token below which a run counts as random: random letters and digits have about 1.3, names with numbers 2, words 3 or more.
MAX_RATIO = 1.75
SPANS = "array<struct<kind string, start long, end long, value string>>"


@functools.cache
def _encoder(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(1 << 16)
def chars_per_token(run: str, vocabulary: str, pattern: str) -> float:
    """Characters a token of a run, encoded in pieces of ``PIECE`` characters."""
    encode = _encoder(vocabulary, pattern).encode_ordinary
    return len(run) / sum(len(encode(run[i : i + PIECE])) for i in range(0, len(run), PIECE))


def is_candidate(run: str) -> bool:
    """Whether a run may be a key: letters and digits together, and no known digest or identifier."""
    return not run.isalpha() and any(c.isdigit() for c in run) and any(c.isalpha() for c in run) and not KNOWN.fullmatch(run)


def secret_spans(text: str, vocabulary: str, pattern: str, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int, str]]:
    """(start, kind's index, end, matched text) of every secret, by start and kind. A random run that overlaps a span of another kind adds nothing and is left out."""
    found = []
    folded = text.lower()
    if any(k in folded for k in KEYWORDS):
        found += [(m.start(), 0, m.end(), m[0]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    runs = list(RUN.finditer(text))
    for run in runs:
        found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text, run.start(), run.end())]
    taken: list[list[int]] = []  # what those cover, as disjoint ranges
    for start, _, end, _ in sorted(found):
        if taken and start < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])
    at = 0
    for run in runs:
        start, end = run.span()
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        free = at == len(taken) or taken[at][0] >= end
        if free and is_candidate(run[0]) and chars_per_token(run[0], vocabulary, pattern) < max_ratio:
            found.append((start, 3, end, run[0]))
    return sorted(found)


def find_secrets(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", max_ratio: float = MAX_RATIO) -> DataFrame:
    """One row a document: ``doc_id`` and ``spans``, an array of (kind, start, end, value) in code points, end exclusive, by start and kind.

    ``vocabulary`` is a tiktoken file of ranks that the executors can read, ``pattern`` its splitting pattern. Rows are scanned where they are read: no shuffle, and batches are bounded by bytes.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e, "value": v} for s, k, e, v in secret_spans(t, vocabulary, pattern, max_ratio)] for t in b.column(1).to_pylist()]
            of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, of)], ["doc_id", "spans"])

    return keyed_text(docs, id_col, text_col).mapInArrow(scan, f"doc_id long, spans {SPANS}")


def redact_secrets(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", mask: str = "[secret]", max_ratio: float = MAX_RATIO) -> DataFrame:
    """``docs`` with every secret of the text replaced by ``mask``; overlapping spans become one mask. All other columns and null texts stay as they are."""
    names, schema = docs.columns, docs.schema
    at = names.index(text_col)
    small_batches(docs.sparkSession)

    def clean(text: str | None) -> str | None:
        out, done = [], 0
        for start, _, end, _ in secret_spans(text or "", vocabulary, pattern, max_ratio):
            if start >= done:
                out += [text[done:start], mask]
            done = max(done, end)
        return text if not done else "".join([*out, text[done:]])

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([clean(t) for t in b.column(at).to_pylist()], b.column(at).type)
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)

    return docs.mapInArrow(redact, schema)


def secret_digest(found: DataFrame) -> DataFrame:
    """Of the rows of ``find_secrets``: counts by kind, a SHA-256 of the spans found by patterns, and all spans as text."""

    def of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        column(found, "doc_id"),
        *(of(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != KINDS[3])), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
