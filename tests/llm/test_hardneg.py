import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.llm import hardneg

SCHEMA = "vec_id long, label int, embedding array<double>"
SHOWN = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, is_anchor):
    """All scores, exactly."""
    fit = [(i, la, [math.floor(256 * c) for c in v]) for i, la, v in rows
           if i is not None and la is not None and v is not None and all(c is not None and math.isfinite(c) and math.isfinite(256 * c) for c in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    long = lambda s: s if -(2**63) <= s < 2**63 else None
    out = []
    for i, la, v in fit:
        if not is_anchor(i):
            continue
        scored = sorted(((-dot(v, w), j, lb) for j, lb, w in fit if j != i), key=lambda x: x[:2])
        for minus, j, _ in [x for x in scored if x[2] == la][:5]:
            window = [x for x in scored if x[2] != la and 50 * -minus <= 100 * -x[0] <= 95 * -minus]
            out += [(i, j, r + 1, k, long(-minus), long(-other)) for r, (other, k, _) in enumerate(window[:3])]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select(SHOWN).collect()), key=repr)


def vectors(seed, n, dims, clusters=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (max(clusters, 1), dims))
    points = rng.normal(0, 0.1 if clusters else 1, (n, dims)) + (centres[rng.integers(0, clusters, n)] if clusters else 0)
    return [(k, int(rng.integers(0, 4)), p.round(3).tolist()) for k, p in enumerate(points)]


def test_the_curve_visits_every_cell_and_goes_in_steps_of_one():
    for n, bits in ((2, 3), (3, 2), (5, 1)):
        cells = np.array(np.meshgrid(*[range(1 << bits)] * n)).reshape(n, -1).T
        keys = hardneg.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_bounds_hold_for_every_row():
    rng = np.random.default_rng(3)
    rows, anchors = rng.integers(-200, 200, (300, 9)).astype(float), rng.integers(-200, 200, (40, 9)).astype(float)
    least, most = hardneg.interval_bounds(anchors, rows.min(0)[None], rows.max(0)[None])
    scores = anchors @ rows.T
    assert (least[:, 0] <= scores.min(1)).all() and (scores.max(1) <= most[:, 0]).all()


@pytest.mark.parametrize("clusters", [0, 6])
def test_results_equal_brute_force(spark, clusters):
    rows = vectors(1 + clusters, 400, 8, clusters)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    result = hardneg.hard_negatives(df, F.col("vec_id") % 9 == 0, block=32)
    assert found(result) == brute(rows, lambda i: i % 9 == 0) and result.count() > 20


def test_bounds_keep_blocks_from_being_read(spark, monkeypatch):
    """Tight clusters far apart: most blocks are read for few anchors."""
    read = []
    plain = hardneg._read

    def counted(wanted, *more):
        read.append(wanted.agg(F.sum(F.length(F.regexp_replace(F.hex("who"), "00", ""))) / 2).first()[0])
        return plain(wanted, *more)

    monkeypatch.setattr(hardneg, "_read", counted)
    rows = vectors(11, 1200, 6, 8)
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(hardneg.hard_negatives(df, F.col("vec_id") % 40 == 0, block=64)) == brute(rows, lambda i: i % 40 == 0)
    # 30 anchors, 19 blocks.
    assert len(read) == 3 and read[0] == 30 and max(read[1:]) < 0.6 * 30 * 19


def test_hard_inputs(spark):
    """Null and unfit rows, ties, repeated rows and ids, ragged vectors, other columns."""
    rows = vectors(5, 60, 3)
    rows += [(None, 1, [1.0, 1.0, 1.0]), (100, None, [1.0, 1.0, 1.0]), (101, 1, None), (102, 1, [1.0, None, 1.0]), (103, 1, [1.0, math.nan, 1.0])]
    rows += [(104, 1, [math.inf, 0.0, 0.0]), (105, 1, [2.0]), (106, 2, []), (107, 3, [0.5, 0.5, 0.5, 9.0]), (108, 2, [1.7e308, 0.0, 0.0])]
    rows += [(110 + k, k % 2, [1.0, 1.0, 1.0]) for k in range(30)] + [(110, 0, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "2 AS block", "'x' AS x", "3 AS anchors", "4 AS place").repartition(4)
    assert found(hardneg.hard_negatives(df, F.col("vec_id") % 5 == 0, block=8)) == brute(rows, lambda i: i % 5 == 0)


def test_scores_beyond_a_long(spark):
    rows = [(k, k % 2, [1e12 * (k + 1), -3e11 * k, 2.0**70 if k % 3 == 0 else 0.5]) for k in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(hardneg.hard_negatives(df, F.col("vec_id") % 2 == 0, block=4)) == brute(rows, lambda i: i % 2 == 0)


def test_scores_as_texts_sort_as_scores():
    scores = [-(10**30), -1001, -999, -10, -9, -1, 0, 1, 9, 10, 99, 100, 10**25]
    texts = [hardneg._text(s) for s in scores]
    assert sorted(texts) == texts and [hardneg._whole(t) for t in texts] == scores


def test_no_rows_and_no_anchors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hardneg.hard_negatives(empty, F.col("vec_id") % 2 == 0).count() == 0
    some = spark.createDataFrame(vectors(1, 9, 2), SCHEMA)
    assert hardneg.hard_negatives(some, F.col("vec_id") < 0).count() == 0
