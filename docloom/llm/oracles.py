"""DuckDB SQL of the training-data operators that SQL can express, over the same tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_FOLDED = _WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
_PLAIN = _WORDS.format("coalesce(text, '')")

BACKOFF_SCORES = f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS before FROM p),
one AS (SELECT word, count(*) AS c FROM g GROUP BY word),
two AS (SELECT before, word, count(*) AS c FROM g WHERE before IS NOT NULL GROUP BY ALL),
s AS (SELECT g.doc_id, sum(CASE WHEN g.before IS NULL THEN ln(one.c / (SELECT count(*) FROM g)) ELSE ln(two.c / context.c) END) AS score
  FROM g JOIN one ON one.word = g.word LEFT JOIN two ON two.before = g.before AND two.word = g.word LEFT JOIN one context ON context.word = g.before GROUP BY g.doc_id)
SELECT d.doc_id, len(w) AS n_words, round(coalesce(score, 0), 6) AS log_score, round(score / len(w), 6) AS mean_log_score FROM d LEFT JOIN s USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_KINDS = ("[a-z]", "[A-Z]", "[0-9]", r"[\x00-\x20]", r"""[.,:;!?''"-]""", r"[()\[\]{}/\\_~`^@+=]", r"[#*$%&|<>]")

QUALITY_RULES = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_PLAIN} AS w FROM documents),
p AS (SELECT doc_id, lang, w, unnest(range(1, len(w) + 1)) AS i FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM p WHERE i + 2 <= len(w)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) t(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
base AS (SELECT doc_id, lang, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
  coalesce(repeated.n, 0) AS n_repeat_words FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
own_chars AS (SELECT doc_id, lang, unnest(range(8)) AS kind, unnest([{", ".join(f"len(regexp_extract_all(text, '{k}'))" for k in _KINDS)}, length(text) - len(regexp_extract_all(text, '{"|".join(_KINDS)}'))]) AS n FROM d),
ref_chars AS (SELECT lang, kind, sum(n) / greatest(sum(sum(n)) OVER (PARTITION BY lang), 1) AS q FROM own_chars GROUP BY lang, kind),
of_words AS (SELECT doc_id, lang, w[i] AS word, count(*) AS n FROM p GROUP BY ALL),
sizes AS (SELECT lang, sum(len(w)) AS size FROM d GROUP BY lang),
common AS (SELECT lang, word, sum(n) AS n FROM of_words GROUP BY lang, word HAVING 500 * sum(n) >= (SELECT size FROM sizes WHERE sizes.lang IS NOT DISTINCT FROM of_words.lang)),
ref_words AS (SELECT common.lang, word AS bin, n / size AS q FROM common JOIN sizes ON sizes.lang IS NOT DISTINCT FROM common.lang
  UNION ALL SELECT sizes.lang, NULL, (size - coalesce(held, 0)) / greatest(size, 1) FROM sizes LEFT JOIN (SELECT lang, sum(n) AS held FROM common GROUP BY lang) h ON h.lang IS NOT DISTINCT FROM sizes.lang),
own_words AS (SELECT doc_id, common.word AS bin, sum(o.n) AS n FROM of_words o LEFT JOIN common ON common.lang IS NOT DISTINCT FROM o.lang AND common.word = o.word GROUP BY ALL),
bins AS (SELECT b.doc_id, 'chars' AS what, c.n / greatest(sum(c.n) OVER (PARTITION BY b.doc_id), 1) AS p, r.q, b.n_words FROM base b JOIN own_chars c USING (doc_id) JOIN ref_chars r ON r.lang IS NOT DISTINCT FROM b.lang AND r.kind = c.kind
  UNION ALL SELECT b.doc_id, 'words', coalesce(o.n, 0) / greatest(b.n_words, 1), r.q, b.n_words FROM base b JOIN ref_words r ON r.lang IS NOT DISTINCT FROM b.lang LEFT JOIN own_words o ON o.doc_id = b.doc_id AND o.bin IS NOT DISTINCT FROM r.bin),
far AS (SELECT doc_id, what, sqrt(greatest(least(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 1), 0)) AS distance, sum(least(1, n_words * q)) AS filled FROM bins GROUP BY doc_id, what),
judged AS (SELECT b.*, c.distance AS chars_distance, w.distance AS words_distance, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_words >= 80 AND (c.distance > 0.12 + 1.25 * sqrt(c.filled * (1 / greatest(n_words, 1) + 1 / greatest(size, 1)) / (8 * ln(2))) OR w.distance > 0.15 + 1.25 * sqrt(w.filled * (1 / greatest(n_words, 1) + 1 / greatest(size, 1)) / (8 * ln(2)))) AS diverges
  FROM base b JOIN far c ON c.doc_id = b.doc_id AND c.what = 'chars' JOIN far w ON w.doc_id = b.doc_id AND w.what = 'words' JOIN sizes ON sizes.lang IS NOT DISTINCT FROM b.lang)
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, round(chars_distance, 6) AS chars_distance, round(words_distance, 6) AS words_distance, base_failed, NOT base_failed AND NOT diverges AS kept FROM judged
"""

NEAREST = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM n WHERE rank <= 10
"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
lost AS (SELECT doc_id, i FROM windows QUALIFY doc_id > min(doc_id) OVER (PARTITION BY g)),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM lost, range(50) t(k)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def _crc32(bytes_list: str) -> str:
    """CRC-32 of a list of bytes, bit by bit."""
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bytes_list}), lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"


def _bytes(text: str) -> str:
    return f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || hex(encode({text}))[2 * i - 1:2 * i])::BIGINT)"


_LOWER_RUNS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

IMPORTANCE_RESAMPLING = f"""
WITH d AS (SELECT doc_id, {_LOWER_RUNS} AS w FROM documents),
words AS (SELECT DISTINCT word FROM (SELECT unnest(w) AS word FROM d UNION ALL SELECT unnest({_LOWER_RUNS}) FROM benchmark)),
buckets AS (SELECT word, {_crc32(_bytes("word"))} % 10000 AS bucket FROM words),
f AS (SELECT doc_id, bucket, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) JOIN buckets USING (word) GROUP BY ALL),
s AS (SELECT bucket, sum(n) AS s FROM f GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest({_LOWER_RUNS}) AS word FROM benchmark) JOIN buckets USING (word) GROUP BY bucket),
sizes AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS whole_s, (SELECT coalesce(sum(t), 0) FROM t) AS whole_t),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (whole_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (whole_t + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), sizes),
weights AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM f JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id::VARCHAR), 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score FROM d LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""

CONVERSATION_TRIE = rf"""
WITH c AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, own, {_crc32(_bytes("conv_id::VARCHAR"))} % 4 AS h FROM c),
r AS (SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS turns FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM r),
nodes AS (SELECT turns[1:depth] AS path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(turns) = depth), '') AS ends,
  any_value(CASE WHEN depth > 0 THEN len(regexp_extract_all(turns[depth].text, '[^ 	-]+')) ELSE 0 END) AS words FROM p GROUP BY turns[1:depth]),
kin AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kin USING (path)),
below AS (SELECT path[1:up] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS up FROM full_nodes) GROUP BY ALL)
SELECT n.conv_id, n.depth, parent.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_nodes n JOIN below USING (path) LEFT JOIN nodes parent ON n.depth > 0 AND parent.path = n.path[1:n.depth - 1]
"""

SQL: dict[str, str] = {
    "op1_backoff_scores": BACKOFF_SCORES,
    "op7_near_duplicates": NEAR_DUPLICATES,
    "op8_quality_rules": QUALITY_RULES,
    "op9_vector_graph": NEAREST,
    "op10_substring_dedup": SUBSTRING_DEDUP,
    "op12_importance_resampling": IMPORTANCE_RESAMPLING,
    "op13_conversation_trie": CONVERSATION_TRIE,
}
