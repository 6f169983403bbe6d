import random
from itertools import combinations

import numpy as np
import pyarrow as pa

from conftest import prose
from daybook.llm import jaccard


def shingles(text, words=3):
    found = [w.decode() for w in (text or "").encode().lower().split()]
    if not found:
        return frozenset()
    width = min(words, len(found))
    return frozenset(tuple(found[k : k + width]) for k in range(len(found) - width + 1))


def brute(rows):
    """doc_id, n_shingles, component_id, class_id, n_links of (doc_id, text) rows."""
    sets = [(i, shingles(t)) for i, t in rows]
    real = [k for k, (i, s) in enumerate(sets) if s and i is not None]
    parent, linked = {k: k for k in real}, dict.fromkeys(real, 0)

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(real, 2):
        common = len(sets[a][1] & sets[b][1])
        similar = 100 * common >= 90 * (len(sets[a][1]) + len(sets[b][1]) - common)
        if similar:
            linked[a], linked[b] = linked[a] + 1, linked[b] + 1
        if similar or sets[a][0] == sets[b][0]:
            parent[root(a)] = root(b)
    least = {}
    for k in real:
        least[root(k)] = min(least.get(root(k), sets[k][0]), sets[k][0])
    first = {}
    for k in real:
        first[sets[k][1]] = min(first.get(sets[k][1], sets[k][0]), sets[k][0])
    return sorted(
        ((i, len(s), least[root(k)], first[s], linked[k]) if k in parent else (i, len(s), i, i, 0) for k, (i, s) in enumerate(sets)), key=repr
    )


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "class_id", "n_links").collect()), key=repr)


def changed(text, k, seed):
    words, pick = text.split(), random.Random(seed)
    for _ in range(k):
        words[pick.randrange(len(words))] = f"new{pick.randint(0, 9_999)}"
    return " ".join(words)


def corpus():
    """Families around the limit of 0.9, passages that many texts share, short texts, chains and copies."""
    pick, rows = random.Random(4), []
    for f in range(12):
        base = prose(100 + f, pick.choice([9, 30, 60, 150, 400]))
        rows += [changed(base, pick.choice([0, 1, 1, 2, 3, 4]), 1000 * f + k) for k in range(12)]
    passage = prose(7, 60)
    rows += [f"{passage} {prose(200 + k, 6)}" for k in range(40)]
    rows += [f"{prose(300 + k, 3)} {passage}" for k in range(30)]
    rows += ["one", "One", "one two", "two one", "one two three", "ONE two\tthree ", "a b a b a b", "a b a b", None, "", " \n"]
    chain = prose(9, 120)
    for k in range(15):
        rows.append(chain)
        chain = changed(chain, 1, 5000 + k)
    return list(enumerate(rows))


def test_classes_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    result = found(jaccard.jaccard_classes(df))
    assert result == brute(rows)
    assert len({r[2] for r in result}) < len(rows) - 60


def test_blocks_of_every_size_give_the_same(spark, monkeypatch):
    """Groups and clusters cut into many blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 900)
    monkeypatch.setattr(jaccard, "_CHUNK", 64)
    rows = corpus()
    assert found(jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_hard_inputs(docs, texts):
    result = jaccard.jaccard_classes(docs)
    assert found(result) == brute([(i, t) for i, t, *_ in texts])


def test_empty_table(nothing):
    assert jaccard.jaccard_classes(nothing).count() == 0


def test_no_similar_pair_is_filtered_out():
    """Whatever n-gram two similar sets meet on, the filters let the pair pass."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(10, 300))
        base = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64) << np.uint64(2))
        other = base.copy()
        other[rng.integers(0, len(base), max(1, len(base) // 25))] = rng.integers(0, 1 << 62, max(1, len(base) // 25))
        sets = [base, np.unique(other)]
        common = np.intersect1d(*sets)
        if 100 * len(common) < 90 * (len(sets[0]) + len(sets[1]) - len(common)):
            continue
        gram = rng.choice(common)
        parts = [np.minimum(np.bincount((s >> np.uint64(58)).astype(int), minlength=64), 255).astype(np.uint8).tobytes() for s in sets]
        table = pa.table(
            {
                "own": [0, 0], "low": [0, 0], "high": [0, 0], "node": [1, 2], "n": [len(s) for s in sets],
                "pos": [int(np.searchsorted(s, gram)) for s in sets], "parts": pa.array(parts, pa.binary()),
            }
        )
        assert jaccard.candidates(table).num_rows == 1


def test_memory_of_words_is_bounded_in_bytes():
    hashes = jaccard.Words()
    hashes.all([b"x" * 1_000_000, b"short"])
    assert set(hashes) == {b"short"}
