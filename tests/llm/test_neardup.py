import random
from itertools import combinations

import numpy as np
import pytest

from daybook.llm import neardup
from daybook.llm.links import components


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def groups(pairs, nodes):
    least = {n: n for n in nodes}

    def root(n):
        while least[n] != n:
            n = least[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        least[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def expected(texts, k):
    sets = [(i, shingles(t, k)) for i, t in texts if i is not None]
    real = [(i, s) for i, s in sets if s]
    near = [(i, j) for (i, a), (j, b) in combinations(real, 2) if 100 * len(a & b) >= 80 * len(a | b)]
    return groups(near, {i for i, _ in sets}), sets


def check(rows, texts, k):
    component, sets = expected(texts, k)
    sizes = sorted((i, len(s)) for i, s in sets)
    assert sorted((r.doc_id, r.n_shingles) for r in rows if r.doc_id is not None) == sizes
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == component[r.doc_id] and r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize("k", [4, 5])
def test_edges(docs, texts, nothing, k):
    check(neardup.near_copies(docs, k).collect(), [t[:2] for t in texts], k)
    assert neardup.near_copies(nothing).count() == 0


def family(seed, copies, words, changes):
    """An origin and copies that are near to it, but seldom to each other; copies of copies among them."""
    pick = random.Random(seed)
    new = lambda: f"w{pick.randint(0, 10**6)}"
    texts = [[new() for _ in range(words)]]
    for _ in range(copies):
        own = list(texts[0] if pick.random() < 0.8 else pick.choice(texts))
        for _ in range(pick.randint(0, changes)):
            own[pick.randrange(words)] = new()
        texts.append(own)
    return [" ".join(t) for t in texts]


@pytest.fixture(scope="module")
def families():
    texts = family(1, 120, 140, 5) + family(2, 30, 40, 2) + family(3, 3, 900, 20) + family(4, 10, 5, 1)
    texts += [t + " " + " ".join(f"s{k}" for k in range(60)) for t in family(5, 40, 100, 100)]
    random.Random(0).shuffle(texts)
    return list(enumerate(texts))


def test_star_shaped_groups(spark, families):
    rows = neardup.near_copies(spark.createDataFrame(families, "doc_id long, text string").repartition(4)).collect()
    check(rows, families, 4)


def test_dense_regions_and_many_blocks(spark, families, monkeypatch):
    """The same with regions that are divided at each depth and clusters of many blocks."""
    monkeypatch.setattr(neardup, "REGION", 8)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "NEIGHBOURS", 2)
    check(neardup.near_copies(spark.createDataFrame(families, "doc_id long, text string")).collect(), families, 4)


def test_rows_that_stay(docs):
    kept = neardup.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == neardup.near_copies(docs, 5).filter("kept").count()


def test_signatures_estimate_similarity():
    random_ = np.random.default_rng(1)
    pool = random_.integers(0, 1 << 63, 1_000, np.uint64)
    a, b = neardup.signature(np.unique(pool[:900])), neardup.signature(np.unique(pool[100:]))
    assert abs(np.mean(a == b) - 0.8) < 0.13


def test_components(spark):
    pick = random.Random(5)
    pairs = [(pick.randint(0, 300), pick.randint(0, 300)) for _ in range(220)]
    pairs += [(k, k + 1) for k in range(400, 480)] + [(900, k) for k in range(500, 700)] + [(7, 7), (3, 4), (4, 3)]
    rows = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    assert {r.node: r.component for r in rows} == groups([p for p in pairs if p[0] != p[1]], nodes)
    assert len(rows) == len(nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
