import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.llm import hmm


@pytest.fixture(scope="module")
def model():
    random = np.random.default_rng(3)
    table = lambda *shape: (lambda x: x / x.sum(-1, keepdims=True))(random.uniform(0.1, 1, shape))
    return hmm.Model(table(3), table(3, 3), table(3, 5))


SEQUENCES = [np.array(s) for s in ([0], [4, 1], [2, 2, 3, 0], [1, 0, 4, 4, 2], [3, 3])]


def paths(model, sequence):
    for states in itertools.product(range(3), repeat=len(sequence)):
        p = model.first[states[0]] * model.classes[states[0], sequence[0]]
        for a, b, seen in zip(states, states[1:], sequence[1:]):
            p *= model.after[a, b] * model.classes[b, seen]
        yield states, p


def scores_of(model, sequences):
    lattice, columns = hmm.Lattice.of(sequences)
    out = np.empty(len(sequences))
    out[columns] = lattice.scores(model)
    return out


def count(model, sequences, counts):
    hmm.Lattice.of(sequences)[0].count(model, counts)


@pytest.mark.parametrize("held", [1, 3, 300_000])
def test_forward_is_the_sum_over_all_paths(model, monkeypatch, held):
    monkeypatch.setattr(hmm, "HELD_TOKENS", held)
    scores = scores_of(model, SEQUENCES)
    assert scores == pytest.approx([math.log10(sum(p for _, p in paths(model, s))) for s in SEQUENCES])


@pytest.mark.parametrize("held", [1, 3, 5, 300_000])
def test_expected_counts(model, monkeypatch, held):
    """Also where so few tokens are held at a time that a lattice, or a single text, is counted in parts."""
    monkeypatch.setattr(hmm, "HELD_TOKENS", held)
    counts = hmm.Counts.none(3, 5)
    count(model, SEQUENCES, counts)
    first, after, classes = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    for s in SEQUENCES:
        total = sum(p for _, p in paths(model, s))
        for states, p in paths(model, s):
            first[states[0]] += p / total
            for a, b in zip(states, states[1:]):
                after[a, b] += p / total
            for state, seen in zip(states, s):
                classes[state, seen] += p / total
    assert counts.first == pytest.approx(first) and counts.after == pytest.approx(after) and counts.classes == pytest.approx(classes)


def test_counts_of_partitions_add_up(spark, model, monkeypatch):
    rows = [(bytearray(s.astype("<u2").tobytes()),) for s in SEQUENCES * 7]
    whole = hmm.Counts.none(3, 5)
    count(model, SEQUENCES * 7, whole)
    for parts in (1, 4):
        found = hmm.expected_counts(hmm.laid_out(spark.createDataFrame(rows, "sequence binary").repartition(parts)), model)
        assert found.classes == pytest.approx(whole.classes, rel=1e-5) and found.after == pytest.approx(whole.after, rel=1e-5)
        assert found.logs == pytest.approx(scores_of(model, SEQUENCES * 7).sum(), rel=1e-6)


def test_what_is_held_does_not_grow_with_a_text(model):
    """A long text is counted in parts of HELD_TOKENS; the result is that of one part."""
    text = [np.random.default_rng(4).integers(0, 5, 3_000)]
    whole, parted = hmm.Counts.none(3, 5), hmm.Counts.none(3, 5)
    lattice, _ = hmm.Lattice.of(text)
    lattice.count(model, whole)
    held, before = [], hmm.HELD_TOKENS
    try:
        hmm.HELD_TOKENS = 100
        assert [b - a for a, b in lattice.parts()] == [100] * 30
        plain = hmm.Lattice._count_part
        hmm.Lattice._count_part = lambda self, m, c, part, *more: held.append(part[1] - part[0]) or plain(self, m, c, part, *more)
        lattice.count(model, parted)
        hmm.Lattice._count_part = plain
    finally:
        hmm.HELD_TOKENS = before
    assert max(held) == 100 and parted.classes == pytest.approx(whole.classes) and parted.after == pytest.approx(whole.after)


def test_a_pass_never_loses_likelihood():
    random = np.random.default_rng(1)
    sequences = [np.concatenate([random.integers(0, 6, 30) + 6 * (k % 2), [12]]) for k in range(40)]
    shares = np.full(13, 1 / 13)
    model, last = hmm.Model.start(shares, 2, 5), -np.inf
    for _ in range(15):
        now = scores_of(model, sequences).sum()
        assert now >= last - 0.5
        last, counts = now, hmm.Counts.none(2, 13)
        count(model, sequences, counts)
        model = hmm.Model.of_counts(counts, shares)
    assert last > len(sequences) * 31 * math.log10(1 / 13)


def test_learns_from_all_texts_to_the_tolerance(spark, monkeypatch):
    """Every pass reads every text: long ones, and more of them than any sample that the states could start from."""
    random = np.random.default_rng(7)
    drawn = [np.append(random.integers(0, 6, 20) + 6 * (k % 2), 18) for k in range(2_500)]
    drawn += [np.append(np.tile([12, 13, 14, 15, 16, 17], 6_000), 18)]
    rows = [(k, len(s), bytearray(s.astype("<u2").tobytes())) for k, s in enumerate(drawn)]
    rows = spark.createDataFrame(rows, "doc_id long, n_tokens long, sequence binary").repartition(4)
    shares, read, one_pass = np.full(19, 1 / 19), [], hmm.expected_counts

    def counted(lattices, model):
        counts = one_pass(lattices, model)
        read.append((counts.first.sum(), counts.classes.sum(), counts.logs))
        return counts

    monkeypatch.setattr(hmm, "expected_counts", counted)
    model = hmm.learnt_from(hmm.laid_out(rows), shares, 3, 1e-3)
    tokens = sum(map(len, drawn))
    assert all(r[:2] == pytest.approx((len(drawn), tokens), rel=1e-4) for r in read)
    gains = np.diff([logs / tokens for *_, logs in read])
    assert (gains[:-1] > 1e-3).all() and gains[-1] <= 1e-3
    alone = hmm.Model.start(shares, 3, hmm.SEED)
    for _ in read:
        counts = hmm.Counts.none(3, 19)
        count(alone, drawn, counts)
        alone = hmm.Model.of_counts(counts, shares)
    assert model.classes == pytest.approx(alone.classes, abs=1e-3) and model.after == pytest.approx(alone.after, abs=1e-3)


def test_no_more_words_than_asked_for_come_to_the_driver(spark, monkeypatch):
    """Also where very many words have the same count."""
    rows = [(bytearray(b"\xff"), 60), (bytearray(b"a"), 61)] + [(bytearray(f"w{k:04}".encode()), 60) for k in range(3_000)]
    words, sizes = spark.createDataFrame(rows, "word binary, n long").repartition(4), []
    kind = type(words)
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: sizes.append(len(rows := collect(self))) or rows)
    assert hmm._frequent(words, 5) == [b"a", b"w0000", b"w0001", b"w0002", b"w0003"]
    assert hmm._frequent(words, 5_000)[-1] == b"\xff"
    assert sizes == [5, 3_002]


def base_scores(texts):
    counts, tokens = Counter(), lambda t: (t or "").encode().lower().split() + [b" "]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    for i, t, *_ in texts:
        if not held(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t, *_ in texts:
        own = tokens(t)
        score = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        out.append((str(i), held(i), len(own), sum(counts[w] > 0 for w in own), n, round(score, 6)))
    return sorted(out)


def test_edges(docs, texts, nothing, monkeypatch):
    rows = hmm.language_scores(docs, frequent=20, endings=8).collect()
    found = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]
    assert sorted(found) == base_scores(texts)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert hmm.language_scores(nothing).count() == 0


def test_small_blocks_give_the_same(spark, docs):
    """The blocks that words are numbered in, and the partitions, don't show in the result."""
    key = lambda rows: sorted((str(r.doc_id), r.n_tokens, round(r.base_score, 5), r.score) for r in rows)
    whole = key(hmm.language_scores(docs, frequent=20, endings=8).collect())
    again = key(hmm.language_scores(docs.repartition(7), frequent=20, endings=8).collect())
    assert [r[:3] for r in whole] == [r[:3] for r in again] and [r[3] for r in whole] == pytest.approx([r[3] for r in again], rel=1e-6)


def test_held_out_texts_are_likelier_than_by_word_counts(spark):
    rows = hmm.language_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    total = rows.filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert total[0] / total[2] > total[1] / total[2] + 0.3
