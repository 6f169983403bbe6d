import hashlib
import re
from collections import defaultdict

import pytest

from daybook.llm import exact


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def expected(texts):
    groups = defaultdict(list)
    for i, t, *_ in texts:
        groups[plain(t)].append((-len(t or ""), i is None, i))
    return groups


@pytest.mark.parametrize("salts", [1, 16])
def test_groups(docs, texts, salts):
    groups = expected(texts)
    rows = exact.exact_groups(docs, salts=salts).collect()
    assert len(rows) == len(texts)
    of = defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
    for i, t, *_ in texts:
        group = groups[plain(t)]
        digest = hashlib.sha256(plain(t).encode()).hexdigest()
        mine = [r for r in of[i] if r.text_sha256 == digest]
        assert {(r.keep_id, r.group_size) for r in mine} == {(min(group)[2], len(group))}
    assert sum(r.kept for r in rows) == len(groups)


def test_rows_that_stay(docs, texts):
    rows = exact.exact_unique(docs)
    assert rows.columns == docs.columns
    best = {content: min(group) for content, group in expected(texts).items()}
    assert sorted(((plain(r.text), -len(r.text or ""), r.doc_id) for r in rows.collect()), key=str) == sorted(
        ((c, size, i) for c, (size, _, i) in best.items()), key=str
    )


def test_hot_group_and_empty_table(spark, nothing):
    rows = spark.range(3_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot text', concat('t', id)) AS text")
    groups = exact.exact_groups(rows)
    assert groups.filter("kept").count() == 2_001 and groups.filter("group_size = 1000 AND keep_id = 0").count() == 1_000
    assert exact.exact_groups(nothing).count() == 0 and exact.exact_unique(nothing).count() == 0


def test_contents_of_one_digest_stay_apart(spark, monkeypatch):
    """With a digest that all texts share, the contents alone tell the groups."""
    monkeypatch.setattr(exact.F, "sha2", lambda c, n: exact.F.lit("same"))
    rows = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c"), (4, "c")], "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in exact.exact_groups(rows).collect()) == [(1, 1, 2, True), (2, 1, 2, False), (3, 3, 2, True), (4, 3, 2, False)]
