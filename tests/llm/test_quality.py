import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_held_out_labels(spark, model):
    rows = quality.scored(spark.read.parquet(f"{SF}/documents.parquet"), model)
    known = rows.filter("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    assert known.filter("predicted = quality").count() >= 0.97 * known.count()
    good = known.filter("quality = 1")
    assert good.filter("predicted = 1").count() >= 0.99 * good.count()


def test_scores_are_sums_of_table_entries(model):
    x = quality.features([b"Some words here.", b"A!! B!! C!!", b"", b"| a | b |" * 9])
    for row, score in zip(x, model.score(x), strict=True):
        bins = [int((row[k] >= e).sum()) for k, e in enumerate(model.edges)]
        total = model.intercept + sum(t[b] for t, b in zip(model.tables, bins, strict=True))
        total += sum(t[model.coarse[i][bins[i]], model.coarse[j][bins[j]]] for (i, j), t in model.pairs.items())
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_learns_features_and_pairs():
    random = np.random.default_rng(0)
    x = random.uniform(0, 1, (4_000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5) | (x[:, 2] > 0.9)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in model.pairs
    fresh = random.uniform(0, 1, (2_000, 4))
    wanted = (fresh[:, 0] > 0.5) ^ (fresh[:, 1] > 0.5) | (fresh[:, 2] > 0.9)
    assert ((model.score(fresh) >= 0.5) == wanted).mean() > 0.95


def test_labels_are_no_inputs(spark, docs, texts, model, nothing):
    rows = quality.scored(docs, model).collect()
    other = quality.scored(docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy"), "doc_id": F.lit(1)}), model).collect()
    assert sorted(r.score for r in rows) == sorted(r.score for r in other)
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert quality.scored(nothing, model).count() == 0 and quality.accepted(nothing, model).count() == 0


def test_rows_that_stay(docs, model):
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == quality.scored(docs, model).filter("predicted = 1").count()


def test_without_labels(spark, docs):
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert {r.score for r in quality.scored(docs, model).collect()} == {0.5}


def test_repeated_labels_and_rows(docs, spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (14, 0), (8, 0), (6, 1), (99, 1)], "doc_id long, quality int")
    first = quality.train(docs, labels)
    again = quality.train(docs.repartition(4), labels.repartition(2))
    x = quality.features([b"a b c", b"x " * 50])
    assert np.array_equal(first.score(x), again.score(x))


def naive_cuts(rows, bins, n_bins, leaves):
    """rows (g, h) with their bins: the value of each bin's leaf, cut by cut, over rows instead of sums."""
    def score(low, high):
        inside = [r for r, b in zip(rows, bins) if low <= b < high]
        return sum(g for g, _ in inside), sum(h for _, h in inside)

    def gain(low, high):
        g, h = score(low, high)
        return g * g / (h + quality.PENALTY)

    bounds = [0, n_bins]
    while len(bounds) <= leaves:
        options = [
            (gain(a, c) + gain(c, b) - gain(a, b), c) for a, b in zip(bounds, bounds[1:]) for c in range(a + 1, b)
        ]
        options = [o for o in options if o[0] > 1e-9]
        if not options:
            break
        bounds = sorted([*bounds, max(options, key=lambda o: o[0])[1]])
    out = [0.0] * n_bins
    for a, b in zip(bounds, bounds[1:]):
        g, h = score(a, b)
        out[a:b] = [g / (h + quality.PENALTY)] * (b - a)
    return out


def naive_fit(x, y):
    """Cyclic boosting as its rule says, row by row."""
    n, width = len(y), len(x[0])
    edges = [sorted(set(np.quantile([r[k] for r in x], np.linspace(0, 1, quality.BINS + 1)[1:-1]))) for k in range(width)]
    bins = [[sum(r[k] >= e for e in edges[k]) for r in x] for k in range(width)]
    rate = (sum(y) + 0.5) / (n + 1)
    total = [float(np.log(rate / (1 - rate)))] * n
    tables = [[0.0] * (len(e) + 1) for e in edges]

    def slopes():
        p = [1 / (1 + np.exp(-t)) for t in total]
        return [(a - b, b * (1 - b)) for a, b in zip(y, p)]

    for _ in range(quality.ROUNDS):
        for k in range(width):
            step = naive_cuts(slopes(), bins[k], len(tables[k]), 3)
            for b, s in enumerate(step):
                tables[k][b] += quality.RATE * s
            for r in range(n):
                total[r] += quality.RATE * step[bins[k][r]]
    m = quality.PAIR_BINS
    cell = [[b * m // len(tables[k]) for b in bins[k]] for k in range(width)]

    def pair_step(i, j):
        rows, best, most = slopes(), {}, 0.0
        for first, second in ((i, j), (j, i)):
            for cut in range(1, m):
                step = {}
                for low, high in ((0, cut), (cut, m)):
                    inside = [r for r in range(n) if low <= cell[first][r] < high]
                    values = naive_cuts([rows[r] for r in inside], [cell[second][r] for r in inside], m, 2)
                    for a in range(low, high):
                        for b in range(m):
                            step[(a, b) if first == i else (b, a)] = values[b]
                at = [step[cell[i][r], cell[j][r]] for r in range(n)]
                gain = sum(s * g - 0.5 * s * s * h for s, (g, h) in zip(at, rows))
                if gain > most + 1e-12:
                    best, most = step, gain
        return best, most

    every = [(i, j) for i in range(width) for j in range(i + 1, width)]
    gains = {p: pair_step(*p)[1] for p in every}
    pairs = {p: np.zeros((m, m)) for p in sorted(every, key=lambda p: (-gains[p], p))[: quality.PAIRS]}
    for _ in range(quality.PAIR_ROUNDS):
        for (i, j), table in pairs.items():
            step = pair_step(i, j)[0]
            for (a, b), s in step.items():
                table[a, b] += quality.RATE * s
            for r in range(n):
                total[r] += quality.RATE * step.get((cell[i][r], cell[j][r]), 0.0)
    return tables, pairs, [1 / (1 + np.exp(-t)) for t in total]


def test_fit_equals_a_naive_one_row_by_row(monkeypatch):
    monkeypatch.setattr(quality, "ROUNDS", 6)
    monkeypatch.setattr(quality, "PAIR_ROUNDS", 2)
    monkeypatch.setattr(quality, "PAIRS", 2)
    random = np.random.default_rng(12)
    x = random.normal(0, 1, (50, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (random.uniform(0, 1, 50) < 0.1)).astype(float)
    model, (tables, pairs, scores) = quality.fit(x, y), naive_fit(x.tolist(), y.tolist())
    for own, other in zip(model.tables, tables, strict=True):
        assert own == pytest.approx(np.array(other))
    assert list(model.pairs) == list(pairs)
    for p, table in pairs.items():
        assert model.pairs[p] == pytest.approx(table)
    assert model.score(x) == pytest.approx(np.array(scores))


def test_an_id_on_very_many_documents_stays_bounded(spark, monkeypatch):
    rows = spark.range(3_000).selectExpr("7L AS doc_id", "concat('text ', id) AS text")
    labels = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(y)))
    quality.train(rows, labels, 100)
    assert seen == [100]
