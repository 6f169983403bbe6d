"""Secret scans by a trigram inverted index.

Each rule's pattern is turned into a Boolean query over trigrams: a disjunction of clauses, each a set of trigrams that
any match must contain. Postings of these trigrams are intersected per clause, and only the documents that are left
are searched with the pattern. Rules without mandatory trigrams search every document.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.text import Tables, whole_text


@dataclass(frozen=True)
class Rule:
    """A match counts if its group `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int
    least: int


# The three base rules, then formats of well-known credentials.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    # A run of a class that is long enough is the same match whether its length is asked for in the pattern or after it.
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 24),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 31),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    Rule("login", r"[a-z][a-z0-9+.-]*://[A-Za-z0-9_.-]+:[^@:/\x20\x09-\x0D]{3,}@[A-Za-z0-9.-]+", 0, 12),
)
RULES = BASE + MORE
# Sets of strings larger than this are cut back to their trigrams while a query is derived.
_MOST_STRINGS = 64


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The clauses of a pattern over lower-case trigrams: a match contains all trigrams of at least one clause. None if
    some match need not contain any trigram."""
    clauses = _simplified(_finish(_walk(parser.parse(pattern))))
    return None if any(not c for c in clauses) else sorted(clauses, key=sorted)


# While a query is derived, a part of a pattern is a list of (exact, prefix, suffix, trigrams): if exact is not None,
# the part matches that string; else all its matches begin with prefix, end with suffix and contain the trigrams.
_Alternative = tuple[str | None, str, str, frozenset[str]]


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _open(a: _Alternative) -> _Alternative:
    exact, prefix, suffix, known = a
    return a if exact is None else (None, exact[:2], exact[-2:], known | _trigrams(exact))


def _join(a: _Alternative, b: _Alternative) -> _Alternative:
    if a[0] is not None and b[0] is not None:
        return (a[0] + b[0], "", "", a[3] | b[3])
    head, tail = (a[0] if a[0] is not None else a[2]), (b[0] if b[0] is not None else b[1])
    known = a[3] | b[3] | _trigrams(head + tail)
    prefix = (a[0] + b[1])[:2] if a[0] is not None else a[1]
    suffix = (a[2] + b[0])[-2:] if b[0] is not None else b[2]
    return (None, prefix, suffix, known)


_ANY: _Alternative = (None, "", "", frozenset())
_EMPTY: _Alternative = ("", "", "", frozenset())


def _walk(items) -> list[_Alternative]:
    out = [_EMPTY]
    for kind, value in items:
        out = _bounded([_join(a, b) for a in out for b in _part(kind, value)])
    return out


def _bounded(out: list[_Alternative]) -> list[_Alternative]:
    out = list(dict.fromkeys(out))
    if len(out) > _MOST_STRINGS:
        out = [(None, "", "", c) for c in _simplified([_open(a)[3] for a in out])]
    if len(out) > _MOST_STRINGS:
        return [(None, "", "", frozenset.intersection(*(a[3] for a in out)))]
    return out


def _part(kind, value) -> list[_Alternative]:
    if kind is op.LITERAL:
        return [(chr(value).lower(), "", "", frozenset())] if value < 128 else [_ANY]
    if kind is op.SUBPATTERN:
        return _walk(value[3])
    if kind is op.BRANCH:
        return _bounded([a for branch in value[1] for a in _walk(branch)])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, inner = value
        once = _walk(inner)
        if (least, most) == (0, 1):
            return _bounded([_EMPTY, *once])
        if least == 0:
            return [_ANY, _EMPTY] if most else [_EMPTY]
        return once if most == 1 else [_join(_open(a), _ANY) for a in once]
    if kind is op.IN:
        chars = set()
        for what, x in value:
            if what is op.LITERAL and x < 128:
                chars.add(chr(x).lower())
            elif what is op.RANGE and x[1] < 128 and x[1] - x[0] < 8:
                chars.update(chr(c).lower() for c in range(x[0], x[1] + 1))
            else:
                return [_ANY]
        return [(c, "", "", frozenset()) for c in sorted(chars)] if len(chars) <= 8 else [_ANY]
    return [_EMPTY] if kind is op.AT else [_ANY]


def _finish(out: list[_Alternative]) -> list[frozenset[str]]:
    return [_open(a)[3] for a in out]


def _simplified(clauses: list[frozenset[str]]) -> set[frozenset[str]]:
    """Without clauses that another clause makes needless."""
    return {c for c in clauses if not any(d < c for d in set(clauses))}


def trigram_postings(texts: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """The inverted index of texts(key, whole) for the trigrams that queries ask for: (trigram, key). Postings that no
    query reads are not made."""
    found = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    return texts.select("key", F.lower("whole").alias("low")).select("key", F.explode(found).alias("trigram"))


def trigram_candidates(postings: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(key, kinds): per document the rules of which a clause has all its trigrams. Postings are intersected
    by counting them, which folds before the shuffle however long a posting list is."""
    spark = postings.sparkSession
    numbered = [(kind, n, t) for kind, clauses in queries.items() for n, c in enumerate(clauses) for t in sorted(c)]
    wanted = spark.createDataFrame(numbered, "kind string, clause int, trigram string")
    sizes = F.create_map(*(F.lit(x) for kind, cs in queries.items() for n, c in enumerate(cs) for x in (f"{kind}:{n}", len(c))))
    clause = F.concat_ws(":", "kind", "clause")
    hits = postings.join(F.broadcast(wanted), "trigram").groupBy("key", clause.alias("clause")).count()
    whole = hits.filter(F.col("count") == sizes[F.col("clause")])
    return whole.groupBy("key").agg(F.collect_set(F.substring_index("clause", ":", 1)).alias("kinds"))


def _lengths(rule: Rule) -> Column:
    """The text cut at a rule's matches: lengths of each gap, of the match after it and of the match's group."""
    parts = F.arrays_zip(
        F.split("whole", rule.pattern, -1).alias("gap"),
        F.regexp_extract_all("whole", F.lit(rule.pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all("whole", F.lit(rule.pattern), F.lit(rule.group)).alias("value"),
    )
    return F.transform(parts, lambda x: F.struct(*(F.length(x[n]).alias(n) for n in ("gap", "hit", "value"))))


def _matches(texts: DataFrame, rules: Sequence[tuple[int, Rule]], chosen: bool) -> DataFrame:
    """(key, place, kind, start, end) of the rules' matches in texts(key, whole), a rule being looked for only where it is
    among `kinds` if that column is there. Lengths of gaps and matches are summed up, so offsets are code points and ends
    are exclusive."""
    found = []
    for place, rule in rules:
        here = F.col("whole").rlike(rule.pattern)
        here = F.array_contains("kinds", rule.kind) & here if chosen else here
        own = F.struct(F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), F.lit(rule.least).alias("least"), _lengths(rule).alias("parts"))
        found.append(F.when(here, own))
    rows = texts.select("key", F.inline(F.array_compact(F.array(*found))))
    rows = rows.select("key", "place", "kind", "least", F.posexplode("parts").alias("nth", "x")).select(
        "key", "place", "kind", "least", "nth", "x.*"
    )
    order = Window.partitionBy("key", "place").orderBy("nth")
    end = F.sum(F.col("gap") + F.coalesce("hit", F.lit(0))).over(order)
    rows = rows.withColumn("end", end).filter(F.col("value") >= F.col("least"))
    return rows.select("key", "place", "kind", (F.col("end") - F.col("hit")).alias("start"), "end")


def secret_spans(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per distinct pair of id and text with a match: key (see `text_key`), spans (array of start, place, kind,
    end). Null texts are empty and have no matches; an empty table gives no rows; other columns are not read.

    Matches of a rule are leftmost and do not overlap; `place` is the rule's place in `rules`, which orders spans of one
    start. Rows that agree in id and text are searched once.
    """
    tables = Tables(docs.sparkSession, "secrets")
    whole = whole_text(text)
    texts = docs.select(text_key(doc_id, whole).alias("key"), whole.alias("whole"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    numbered = list(enumerate(rules))
    found = []
    if queries:
        trigrams = sorted({t for q in queries.values() for c in q for t in c})
        chosen = trigram_candidates(trigram_postings(texts, trigrams), queries)
        chosen = tables.write(texts.join(chosen, "key").dropDuplicates(["key"]), "candidates")
        found.append(_matches(chosen, [(n, r) for n, r in numbered if r.kind in queries], True))
    if whole_scans := [(n, r) for n, r in numbered if r.kind not in queries]:
        somewhere = F.greatest(*(F.col("whole").rlike(r.pattern) for _, r in whole_scans), F.lit(False))
        found.append(_matches(texts.filter(somewhere).dropDuplicates(["key"]), whole_scans, False))
    span = F.struct("start", "place", "kind", "end")
    return reduce(DataFrame.unionByName, found).groupBy("key").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def text_key(doc_id: str, whole: Column) -> Column:
    """One string for id and text."""
    return F.concat_ws(":", F.col(doc_id).cast("string"), F.xxhash64(whole).cast("string"))
