import random

import pytest

from daybook.llm import lines


def brute(texts, least):
    """All runs of at least `least` words, in order; lines of those that stood earlier."""
    seen, gone = set(), {}
    for i, t in sorted(set((i, t or "") for i, t, *_ in texts), key=lambda x: (x[0] is None, x[0])):
        own = [(k, x.strip(" \t\r\x0b\f"), len(x.encode().split())) for k, x in enumerate(t.split("\n"))]
        own = [x for x in own if x[2]]
        out = gone.setdefault((i, t), set())
        for a in range(len(own)):
            words = 0
            for b in range(a, min(len(own), a + 40)):
                words += own[b][2]
                run = tuple(x[1] for x in own[a : b + 1])
                if words >= least and run in seen:
                    out.update(range(own[a][0], own[b][0] + 1))
                elif words >= least:
                    seen.add(run)
    return gone


def deleted(row):
    runs = [r.split("-") for r in row.deleted.split(",") if r]
    return {k for a, b in runs for k in range(int(a), int(b) + 1)}


def check(df, texts, least):
    rows = lines.deduplicated(df, least).collect()
    assert len(rows) == len(texts)
    expected = brute(texts, least)
    left = {}
    for (i, t), gone in expected.items():
        left.setdefault(i, []).append((sorted(gone), "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)))
    for r in rows:
        assert (sorted(deleted(r)), r.text) in left[r.doc_id]
        assert r.n_deleted == len(deleted(r))
    return rows


def test_edges(docs, texts, nothing):
    rows = check(docs, texts, 50)
    assert {r.doc_id: r.n_words_deleted for r in rows}[12] == 72
    assert lines.deduplicated(nothing).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_lines(spark, seed):
    pick = random.Random(seed)
    stock = [" ".join(pick.choice("abcdefgh") for _ in range(pick.randint(1, 6))) for _ in range(14)]
    texts = []
    for i in range(60):
        own = [pick.choice([*stock, "", " "]) for _ in range(pick.randint(0, 12))]
        if texts and pick.random() < 0.7:
            source = pick.choice(texts)[1].split("\n")
            a = pick.randrange(len(source))
            own[len(own) // 2 : len(own) // 2] = source[a : a + pick.randint(1, 8)]
        texts.append((i, "\n".join(own)))
    check(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), texts, 8)


def test_every_shared_run_has_a_shared_fingerprint():
    pick = random.Random(7)
    line = lambda: " ".join(pick.choice("stuvw") + str(pick.randint(0, 99)) for _ in range(pick.randint(1, 20)))
    for _ in range(50):
        run = [line() for _ in range(8)]
        a, b = ("\n".join([line() for _ in range(3)] + run + [line() for _ in range(3)]).encode() for _ in range(2))
        if sum(len(x.split()) for x in run) >= 50:
            assert {w[2] for w in lines.windows_of(a, 50)} & {w[2] for w in lines.windows_of(b, 50)}
