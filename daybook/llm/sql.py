"""The same results in DuckDB SQL, where SQL can express an operator."""

from __future__ import annotations

import re

from daybook.llm import jaccard
from daybook.llm.hardneg import HIGH, LOW, NEGATIVES, POSITIVES, SCALE
from daybook.llm.lines import LEAST_WORDS
from daybook.llm.merkle import FAN, FIELDS
from daybook.llm.mixing import SEED
from daybook.llm.neardup import SIMILARITY, WORDS
from daybook.llm.rules import LEAST_DOCUMENTS
from daybook.llm.secrets import BASE, RULES


def _plain(pattern: str) -> str:
    """(?i:...) spelt out, so that only letters of ASCII match in either case."""

    def either(m: re.Match) -> str:
        return "(?:" + re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]) + ")"

    return re.sub(r"\(\?i:([^()]*)\)", either, pattern).replace("'", "''")


def _secrets() -> str:
    found = "\nUNION ALL ".join(
        f"""SELECT r, {place} AS place, '{rule.kind}' AS kind, least, n, sum(gap + hit) OVER (PARTITION BY r ORDER BY n) AS "end", hit, val FROM (
  SELECT r, {rule.least} AS least, unnest(list_transform(string_split_regex(w, '{_plain(rule.pattern)}')[:-2], lambda x: length(x))) AS gap,
         unnest(list_transform(regexp_extract_all(w, '{_plain(rule.pattern)}', 0), lambda x: length(x))) AS hit,
         unnest(list_transform(regexp_extract_all(w, '{_plain(rule.pattern)}', {rule.group}), lambda x: length(x))) AS val,
         unnest(range(1, 1 + len(regexp_extract_all(w, '{_plain(rule.pattern)}', 0)))) AS n
  FROM t WHERE regexp_matches(w, '{_plain(rule.pattern)}'))"""
        for place, rule in enumerate(RULES)
    )
    span = "kind || ':' || (\"end\" - hit)::BIGINT || ':' || \"end\"::BIGINT"
    order = '("end" - hit), place, "end"'
    counted = ", ".join(f"count(m.r) FILTER (kind = '{rule.kind}') AS n_{rule.kind}" for rule in BASE)
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS w FROM documents),
m AS (SELECT * FROM ({found}) WHERE val >= least)
SELECT doc_id, {counted},
  sha256(coalesce(string_agg({span}, ',' ORDER BY {order}) FILTER (place < {len(BASE)}), '')) AS base_sha256,
  coalesce(string_agg({span}, ',' ORDER BY {order}) FILTER (m.r IS NOT NULL), '') AS spans
FROM t LEFT JOIN m ON t.r = m.r GROUP BY t.r, doc_id
"""


_EXACT = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS w FROM documents),
c AS (SELECT doc_id, length(w) AS chars, regexp_replace(w, '[\x20\x09-\x0D]', '', 'g') AS content FROM t),
g AS (SELECT *, count(*) OVER (PARTITION BY content) AS group_size,
             first_value(doc_id) OVER (PARTITION BY content ORDER BY chars DESC, doc_id) AS keep_id FROM c)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM g
"""

_COUNTS = r"""
t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS w FROM documents),
words AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i
          FROM (SELECT r, regexp_extract_all(w, '[^\x20\x09-\x0D]+') AS ws FROM t)),
wins AS (SELECT r, i, word || ' ' || lead(word) OVER p || ' ' || lead(word, 2) OVER p AS win
         FROM words WINDOW p AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM wins WHERE win IS NOT NULL) WHERE n > 1),
covered AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + d.d AS i FROM again, (VALUES (0), (1), (2)) d(d)) GROUP BY r),
rows_of AS (SELECT r, unnest(string_split(w, chr(10))) AS line FROM t),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dups
          FROM rows_of WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
counts AS (
  SELECT t.r, doc_id, lang, source, len(regexp_extract_all(w, '[^\x20\x09-\x0D]+')) AS n_words,
    length(regexp_replace(w, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(w, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(w, '[^A-Z]', '', 'g')) AS n_upper,
    coalesce(lines.n, 0) AS n_lines, coalesce(dups, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM t LEFT JOIN lines ON lines.r = t.r LEFT JOIN covered ON covered.r = t.r)"""


def _rules() -> str:
    measures = {
        "symbols": ("n_symbols", 10_000, "word_chars"),
        "upper": ("n_upper", 10_000, "word_chars"),
        "dup_lines": ("n_dup_lines", 10_000, "n_lines"),
        "repeats": ("n_repeat_words", 10_000, "n_words"),
        "word_length": ("word_chars", 100, "n_words"),
    }
    listed = ", ".join(f"CASE WHEN {of} > 0 THEN ({n} * {scale}) // {of} ELSE 0 END AS {name}" for name, (n, scale, of) in measures.items())
    long = "\nUNION ALL ".join(
        f"SELECT lang, source, '{name}' AS measure, {column} AS x FROM judged WHERE NOT base_failed" for name, column in [*((m, m) for m in measures), ("size", "word_chars")]
    )

    def level(name: str, columns: str) -> str:
        by = f"{columns}, " if columns else ""
        group = f"PARTITION BY {by}measure"
        return f"""
{name} AS (SELECT {by}measure, docs, q1, q3, max(least) FILTER (measure = 'size') OVER ({f"PARTITION BY {columns}" if columns else ""}) AS smallest FROM (
  SELECT {by}measure, sum(n) AS docs, min(bucket) AS least, coalesce(min(bucket) FILTER (k > 0 AND 4 * upto >= total), 0) AS q1,
    coalesce(min(bucket) FILTER (k > 0 AND 4 * upto >= 3 * total), 0) AS q3
  FROM (SELECT *, sum(k) OVER ({group} ORDER BY bucket) AS upto, sum(k) OVER ({group}) AS total
        FROM (SELECT {by}measure, bucket, count(*) AS n, CASE WHEN bucket > 0 OR measure NOT IN ('dup_lines', 'repeats') THEN count(*) ELSE 0 END AS k
              FROM buckets GROUP BY {by}measure, bucket)) GROUP BY {by}measure))"""

    def taken(column: str) -> str:
        return f"CASE WHEN s.docs >= {LEAST_DOCUMENTS} THEN s.{column} WHEN l.docs >= {LEAST_DOCUMENTS} THEN l.{column} ELSE a.{column} END AS {column}"

    inside = " AND ".join(f"c.{name} <= max(f.hi) FILTER (f.measure = '{name}')" for name in measures)
    shown = "c.doc_id, c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, c.base_failed"
    return f"""
WITH {_COUNTS},
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {listed} FROM counts),
measured AS ({long}),
buckets AS (SELECT lang, source, measure, CASE WHEN length(bin(x)) > 7 THEN (x >> (length(bin(x)) - 7)) << (length(bin(x)) - 7) ELSE x END AS bucket
            FROM measured),{level("by_source", "lang, source")},{level("by_lang", "lang")},{level("overall", "")},
chosen AS (SELECT s.lang, s.source, s.measure, {taken("q1")}, {taken("q3")}, {taken("smallest")}
  FROM by_source s JOIN by_lang l ON l.lang IS NOT DISTINCT FROM s.lang AND l.measure = s.measure JOIN overall a ON a.measure = s.measure
  WHERE s.measure <> 'size'),
reaches AS (SELECT *, greatest(3 * greatest(q3 - q1, 1 << greatest(length(bin(q3)) - 7, 0)), CASE WHEN measure IN ('symbols', 'upper') THEN coalesce(10000 // nullif(smallest, 0), 0) ELSE 0 END) AS reach FROM chosen),
fences AS (SELECT lang, source, measure, q3 + (1 << greatest(length(bin(q3)) - 7, 0)) - 1 + reach AS hi, q1 - reach AS lo FROM reaches)
SELECT c.doc_id, c.n_words::BIGINT AS n_words, c.word_chars::BIGINT AS word_chars, c.n_symbols::BIGINT AS n_symbols,
  c.n_dup_lines::BIGINT AS n_dup_lines, c.n_repeat_words::BIGINT AS n_repeat_words, c.base_failed,
  coalesce(NOT c.base_failed AND {inside} AND c.word_length >= max(f.lo) FILTER (f.measure = 'word_length'), false) AS kept
FROM judged c LEFT JOIN fences f ON f.lang IS NOT DISTINCT FROM c.lang AND f.source IS NOT DISTINCT FROM c.source
GROUP BY c.r, {shown}, {", ".join(f"c.{name}" for name in measures)}
"""


def _mix() -> str:
    order = "draw, doc_id, size, r"
    return rf"""
WITH RECURSIVE sized AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce('1' || source, '0') AS name,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS draw FROM documents),
sources AS (SELECT name, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY name = '0', encode(name)) - 1) % 3]::DOUBLE AS weight
  FROM sized GROUP BY name),
ranked AS (SELECT *, 2 * source_size AS cap, row_number() OVER (ORDER BY 2 * source_size / weight, name = '0', encode(name)) AS place FROM sources),
levels AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
targets AS (SELECT name, source_size, least(cap::DOUBLE, coalesce((SELECT arg_min(level, place) FROM levels WHERE level <= cap / weight) * weight, 'inf'::DOUBLE)) AS target
  FROM levels),
wants AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::INTEGER AS whole FROM targets),
-- One round after the other, until no document that is not drawn fits what its source still wants.
rounds AS (
  SELECT 0 AS k, s.r, s.name, s.draw, s.doc_id, s.size, round(target - whole * source_size)::BIGINT AS open, false AS extra
  FROM sized s JOIN wants w ON w.name = s.name WHERE size > 0
  UNION ALL
  SELECT k, r, name, draw, doc_id, size, open - coalesce(sum(size) FILTER (extra) OVER (PARTITION BY name), 0)::BIGINT, extra FROM (
    SELECT k + 1 AS k, r, name, draw, doc_id, size, open, sum(size) OVER (PARTITION BY name ORDER BY {order}) <= open AS extra
    FROM rounds WHERE NOT extra AND size <= open)),
drawn AS (SELECT DISTINCT r FROM rounds WHERE extra)
SELECT s.doc_id, size, source_size, target, (whole + (d.r IS NOT NULL)::INTEGER) * size AS taken, source, (whole + (d.r IS NOT NULL)::INTEGER)::INTEGER AS copies
FROM sized s JOIN wants w ON w.name = s.name LEFT JOIN drawn d ON d.r = s.r
"""


_CHAT = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, t, ['user', 'assistant'][t + 1], '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0), (1)) v(t)),
p AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM c),
e AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS body,
  regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') AS head FROM p)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(head) + 1 + length(body) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_LINES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS w FROM documents),
l AS (SELECT doc_id, line, place, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM (
  SELECT doc_id, unnest(string_split(w, chr(10))) AS line, unnest(range(0, len(string_split(w, chr(10))))) AS place FROM d)),
s AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS plain,
  row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k, sum(n) OVER (PARTITION BY doc_id ORDER BY place) AS upto FROM l WHERE n > 0),
enough AS (SELECT a.doc_id, a.k AS first, b.k AS last FROM s a JOIN s b ON b.doc_id = a.doc_id AND b.k >= a.k AND b.upto - a.upto + a.n >= {LEAST_WORDS}),
windows AS (SELECT doc_id, first, min(last) AS last FROM enough GROUP BY 1, 2
  UNION SELECT doc_id, max(first), last FROM enough GROUP BY doc_id, last),
runs AS (SELECT w.doc_id, first, last, string_agg(md5(plain), ',' ORDER BY k) AS seq
  FROM windows w JOIN s ON s.doc_id = w.doc_id AND s.k BETWEEN first AND last GROUP BY 1, 2, 3),
again AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY seq ORDER BY doc_id, first) > 1),
gone AS (SELECT DISTINCT r.doc_id, l.place FROM again r JOIN s a ON a.doc_id = r.doc_id AND a.k = first
  JOIN s b ON b.doc_id = r.doc_id AND b.k = last JOIN l ON l.doc_id = r.doc_id AND l.place BETWEEN a.place AND b.place),
spans AS (SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS deleted FROM (
  SELECT doc_id, min(place) AS a, max(place) AS b FROM (
    SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS island FROM gone) GROUP BY doc_id, island) GROUP BY doc_id),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.place) AS n_deleted, coalesce(sum(n) FILTER (g.place IS NOT NULL), 0)::BIGINT AS n_words_deleted,
  coalesce(string_agg(line, chr(10) ORDER BY l.place) FILTER (g.place IS NULL), '') AS text
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.place = l.place GROUP BY 1)
SELECT doc_id, n_lines, n_deleted, n_words_deleted, coalesce(deleted, '') AS deleted, sha256(text) AS text_sha256, length(text)::BIGINT AS n_chars
FROM kept LEFT JOIN spans USING (doc_id)
"""

_NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {WORDS} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {WORDS} + 2), lambda i: array_to_string(ws[i : i + {WORDS} - 1], ' ')) END) AS s FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c.n >= {SIMILARITY} * (x.n + y.n - c.n)),
reach AS (SELECT doc_id, doc_id AS to_id FROM w UNION SELECT r.doc_id, b FROM reach r JOIN links ON a = to_id)
SELECT r.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(to_id) AS component_id, r.doc_id = min(to_id) AS kept
FROM reach r LEFT JOIN sizes z ON z.doc_id = r.doc_id GROUP BY r.doc_id
"""


# crc32 of an ASCII text: a table made by the reflected polynomial, then one step per character.
_CRC_TABLE = """crc AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS of
  FROM range(256) t(i))"""


def _crc(text: str) -> str:
    step = "xor(c // 256, crc.of[1 + xor(c % 256, k)])"
    return f"xor(list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, k: {step}), 4294967295)"


def _manifest() -> str:
    def part(v: str) -> str:
        return f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(part(text if f == 'text' else f) for f in FIELDS)})"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name: str, first: str) -> str:
        return f"""{name} AS ({first} UNION ALL
  SELECT tree, level + 1, place // {FAN}, sha256(string_agg(digest, '' ORDER BY place)), (any_value(n) + {FAN - 1}) // {FAN}
  FROM {name} WHERE n > 1 GROUP BY tree, level, place // {FAN})"""

    return f"""
WITH RECURSIVE {_CRC_TABLE},
l AS (SELECT row_number() OVER () AS r, doc_id, source, {leaf("text")} AS leaf,
  CASE WHEN {_crc("doc_id::VARCHAR")} % 5 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS claim FROM documents, crc),
s AS (SELECT *, dense_rank() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS tree,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, claim) - 1 AS place FROM l),
{tree("low", "SELECT tree, 0 AS level, place, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM s")},
{tree("top", "SELECT -1 AS tree, 0 AS level, tree AS place, digest, count(*) OVER () AS n FROM low WHERE n = 1")},
nodes AS (SELECT * FROM low UNION ALL SELECT * FROM top),
sides AS (SELECT a.tree, a.level, a.place, any_value(a.n) AS n,
    coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS lefts,
    coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS rights
  FROM nodes a JOIN nodes b ON b.tree = a.tree AND b.level = a.level AND b.place // {FAN} = a.place // {FAN} GROUP BY ALL),
walk AS (SELECT r, tree, 0 AS level, place, claim AS digest, '' AS proof, false AS done FROM s UNION ALL
  SELECT r, CASE WHEN n > 1 THEN w.tree ELSE -1 END, CASE WHEN n > 1 THEN w.level + 1 ELSE 0 END, CASE WHEN n > 1 THEN w.place // {FAN} ELSE w.tree END,
    CASE WHEN n > 1 THEN sha256(lefts || digest || rights) ELSE digest END, CASE WHEN n > 1 THEN proof || lefts || rights ELSE proof END, n = 1 AND w.tree = -1
  FROM walk w JOIN sides x ON x.tree = w.tree AND x.level = w.level AND x.place = w.place WHERE NOT done)
SELECT doc_id, leaf, d.digest AS subroot, t.digest AS root, sha256(w.proof) AS proof_sha256, w.digest AS folded_root, w.digest = t.digest AS verified,
  s.place::BIGINT AS place, (length(w.proof) // 64)::INTEGER AS n_siblings
FROM s JOIN walk w ON w.r = s.r AND w.done JOIN low d ON d.tree = s.tree AND d.n = 1 JOIN top t ON t.n = 1
"""


_HARD = f"""
WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}),
n AS (SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)::INTEGER AS rank,
    n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score)
SELECT * FROM n WHERE rank <= {NEGATIVES}
"""

_JACCARD = _NEAR.partition("reach AS")[0].replace(f"< {WORDS}", f"< {jaccard.WORDS}").replace(f"- {WORDS} + 2", f"- {jaccard.WORDS} + 2").replace(
    f"i + {WORDS} - 1", f"i + {jaccard.WORDS} - 1").replace(f">= {SIMILARITY} *", f">= {jaccard.SIMILARITY} *") + """
same AS (SELECT a, min(b) AS least FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE c.n = x.n AND c.n = y.n GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reach AS (SELECT doc_id, doc_id AS to_id FROM w UNION SELECT r.doc_id, b FROM reach r JOIN links ON a = to_id)
SELECT r.doc_id, coalesce(any_value(z.n), 0)::BIGINT AS n_shingles, min(to_id) AS component_id,
  least(r.doc_id, coalesce(any_value(same.least), r.doc_id)) AS class_id, coalesce(any_value(counted.n), 0)::BIGINT AS n_links
FROM reach r LEFT JOIN sizes z ON z.doc_id = r.doc_id LEFT JOIN same ON same.a = r.doc_id LEFT JOIN counted ON counted.a = r.doc_id GROUP BY r.doc_id
"""


ORACLE: dict[str, str] = {
    "op1_secret_scans": _secrets(),
    "op2_chat_formatting": _CHAT,
    "op3_line_dedup": _LINES,
    "op7_near_copies": _NEAR,
    "op8_exact_dedup": _EXACT,
    "op9_quality_rules": _rules(),
    "op10_mixing_sources": _mix(),
    "op11_merkle_manifest": _manifest(),
    "op12_hard_negatives": _HARD,
    "op13_ngram_jaccard": _JACCARD,
}
