import random

from pyspark.sql import functions as F

from daybook.operators.ordered import OrderedRows, highest, latest, previous, total


def test_carries_equal_a_plain_loop_for_a_key_split_over_many_chunks(spark):
    rng = random.Random(7)
    rows = []
    for key, n in (("hot", 400), ("b", 3), ("c", 60), ("a", 1)):
        for i in range(n):
            rows.append((key, i, rng.choice([None, rng.randint(0, 50)])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, v long")
    ordered = OrderedRows(df, ["k"], ["i"], chunks=9)
    assert ordered.rows.select("_chunk").distinct().count() > 5
    got = ordered.carry(
        p=previous(F.col("v")), l=latest(F.col("v")), s=total(F.col("v")), h=highest(F.col("v"))
    ).collect()
    assert len(got) == len(rows)
    found = {(r.k, r.i): (r.p, r.l, r.s, r.h) for r in got}
    for key in ("hot", "a", "b", "c"):
        prev = last = high = None
        acc = 0
        for _, i, v in sorted(
            (r for r in rows if r[0] == key), key=lambda r: r[1]
        ):
            assert found[(key, i)] == (prev, last, acc, high)
            prev = v
            if v is not None:
                last, acc = v, acc + v
                high = v if high is None else max(high, v)
