from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from daybook.llm import mixing


def filled(sizes, weights=(5.0, 2.0, 1.0), share=1.5, epochs=2):
    """Deal, clamp, deal the excess again."""
    names = sorted(sizes, key=lambda n: (n is None, (n or "").encode()))
    weight = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[n] for n in open_)
        above = {n for n in open_ if left * weight[n] / total > epochs * sizes[n]}
        if not above:
            return target | {n: left * weight[n] / total for n in open_}
        for n in above:
            target[n] = float(epochs * sizes[n])
        left -= sum(epochs * sizes[n] for n in above)
        open_ -= above
    return target


@pytest.mark.parametrize(
    "sizes", [{"a": 10, "b": 20, "c": 1000, None: 5}, {"a": 0, "b": 0}, {"z": 7}, {"a": 100, "b": 100, "é": 100, "\U0001f600": 1, None: 0}]
)
def test_water_fill(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixing.water_fill(rows).collect()}
    assert found == pytest.approx(filled(sizes))
    assert sum(found.values()) == pytest.approx(1.5 * sum(sizes.values()))


def checked(rows, count):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
    assert len(rows) == count and target == pytest.approx(filled(sizes))
    return sizes, taken, target


def test_edges(docs, texts, nothing):
    rows = mixing.mix(docs).collect()
    sizes, _, _ = checked(rows, len(texts))
    assert all(r.source_size == sizes[r.source] for r in rows)
    assert mixing.mix(nothing).count() == 0
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_sources_come_near_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    _, taken, target = checked(mixing.mix(docs).collect(), 1_000)
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in target)
    assert sum(abs(taken[s] - target[s]) for s in target) <= 0.005 * sum(target.values())


def test_bins_are_the_same_draw(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wide = sorted((r.doc_id, r.taken) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "_BIN_BITS", 0)
    assert wide == sorted((r.doc_id, r.taken) for r in mixing.mix(docs).collect())


def test_mixture_repeats_whole_rows(docs):
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns
    found = {(r.doc_id, r.text): r["count"] for r in mixed.groupBy("doc_id", "text").count().collect()}
    wanted = mixing.mix(docs).filter("copies > 0").groupBy("doc_id", "key").agg(F.sum("copies").alias("n"))
    assert sorted(found.values()) == sorted(r.n for r in wanted.filter("n > 0").collect())


def test_rounds_go_on_until_no_document_fits(spark):
    """Documents of falling size block one round each."""
    order = [r.i for r in spark.range(1_000).select(F.col("id").alias("i"), mixing._draw(mixing.SEED, F.col("id")).alias("d")).orderBy("d").collect()]
    # 1,500 words are wanted, so 500 are drawn: 260 leave 240, then each is larger than half of what is still open.
    sizes = [260, 250, 130, 120, 66, 60, 33, 30, 17, 15, 9, 8, 2]
    rows = [(i, " ".join(["w"] * n), "a") for i, n in zip(order, sizes, strict=False)]
    rows = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    open_ = rows[0].target - sum(r.taken for r in rows)
    assert open_ >= 0 and not any(r.copies == 1 and r.size <= open_ for r in rows)
