import hashlib
import re

import pytest
from pyspark.sql import functions as F

from daybook.llm import secrets

KEY = "Q7" * 10
HEX = "0123456789abcdef" * 2
TEXTS = [
    "password: token = " + KEY,
    f"API_KEY='{KEY}' and apikey = \"{KEY}\" PASSWD={KEY}=== secret:short",
    f"é\U0001f600 AKIA{'A1' * 8} AKIAshort AKIA{'B' * 13} AKIAAKIA{'C' * 14}",
    f"hash {HEX}{HEX.upper()} 0123456789abcde {HEX}g{HEX}",
    f"ghp_{'a' * 36} xoxb-{'1' * 12} AIza{'z' * 35} sk_live_{'9' * 20} ftp://me:pass@host.example/x",
    "-----BEGIN RSA PRIVATE KEY----- eyJabcdefgh.eyJabcdefgh.abcdefgh",
    "tok en = abcdefghijklmnop", "tokena:bcdefghijklmnop", "Key apiKey = abcdefghijklmnop", "", None,
]


def found(text, rules):
    spans = []
    for place, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m[rule.group]) >= rule.least:
                spans.append((m.start(), place, m.end(), rule.kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans)]


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [(n, t) for n, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (0, TEXTS[1]), (None, TEXTS[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("spans", F.lit(1))
    out = secrets.secret_spans(docs)
    return {r.key: [f"{s.kind}:{s.start}:{s.end}" for s in r.spans] for r in out.collect()}, docs


def test_spans_are_those_of_a_plain_search(scanned):
    spans, docs = scanned
    keyed = docs.select(secrets.text_key("doc_id", F.coalesce("text", F.lit(""))).alias("k"), "text").collect()
    assert {k: v for k, v in spans.items()} == {r.k: found(r.text, secrets.RULES) for r in keyed if found(r.text, secrets.RULES)}
    assert sum(map(len, spans.values())) > 15


def test_query_result(spark, tmp_path):
    spark.createDataFrame([(n, t) for n, t in enumerate(TEXTS)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    from daybook.llm.queries import op1_secret_scans

    rows = {r.doc_id: r for r in op1_secret_scans(spark, str(tmp_path)).collect()}
    for n, text in enumerate(TEXTS):
        base = found(text, secrets.BASE)
        assert rows[n].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert rows[n].spans == ",".join(found(text, secrets.RULES))
        assert [rows[n].n_assign, rows[n].n_access, rows[n].n_hex] == [
            sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")
        ]


def test_trigram_queries():
    assert secrets.trigram_query("AKIA[A-Z0-9]{14,}") == [frozenset({"aki", "kia"})]
    assert secrets.trigram_query("[0-9a-f]{16,}") is None
    assert secrets.trigram_query("(abcd|efg)x?") == [frozenset({"abc", "bcd"}), frozenset({"efg"})]
    assert secrets.trigram_query("ab") is None
    assert secrets.trigram_query("ab*cde") == [frozenset({"cde"})]
    assert secrets.trigram_query("(?:abc)?") is None


def test_every_match_satisfies_its_query():
    for text in filter(None, TEXTS):
        for rule in secrets.RULES:
            query = secrets.trigram_query(rule.pattern)
            for m in re.finditer(rule.pattern, text, re.ASCII):
                assert query is None or any(all(t in m[0].lower() for t in clause) for clause in query)


def test_empty_table(nothing):
    assert secrets.secret_spans(nothing).count() == 0


def test_a_very_long_text(spark):
    """Spans of a text of two million characters, at its begin, middle and end."""
    filler = "plain words and 12345 numbers, é😀 " * 20_000
    text = f"password={KEY} {filler} AKIA{'B' * 16} {filler} token: {KEY}"
    docs = spark.createDataFrame([(1, text), (2, filler)], "doc_id long, text string")
    [row] = secrets.secret_spans(docs).collect()
    assert [f"{s.kind}:{s.start}:{s.end}" for s in row.spans] == found(text, secrets.RULES) and len(row.spans) >= 3
