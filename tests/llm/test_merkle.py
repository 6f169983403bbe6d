import hashlib
import random
import string

import pytest
from pyspark.sql import functions as F

from daybook.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def up(level):
    return [digest("".join(level[a : a + 16])) for a in range(0, len(level), 16)]


def proof_of(leaves, at):
    """Siblings from a leaf up to the root of a list, and the root."""
    siblings = []
    while len(leaves) > 1:
        run = leaves[at - at % 16 : at - at % 16 + 16]
        siblings.append((run[: at % 16], run[at % 16 + 1 :]))
        leaves, at = up(leaves), at // 16
    return siblings, leaves[0]


def brute(rows):
    """{(doc_id, leaf, place): (subroot, root, proof, folded root of a claim)} of (fields, claim) rows."""
    groups = {}
    for fields, claim in rows:
        groups.setdefault(fields[1], []).append((fields[0] is not None, fields[0] or 0, leaf_of(fields), claim or leaf_of(fields), fields[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for group in groups.values():
        group.sort(key=lambda r: r[:4])
    subroots = [proof_of([r[2] for r in groups[g]], 0)[1] for g in names]
    out = []
    for n, g in enumerate(names):
        leaves = [r[2] for r in groups[g]]
        above, root = proof_of(subroots, n)
        for at, row in enumerate(groups[g]):
            siblings = proof_of(leaves, at)[0] + above
            folded = row[3]
            for left, right in siblings:
                folded = digest("".join(left) + folded + "".join(right))
            proof = [s for left, right in siblings for s in [*left, *right]]
            out.append((row[4], row[2], at, subroots[n], root, proof, digest("".join(proof)), folded, folded == root))
    return sorted(out, key=repr)


def found(df):
    names = ["doc_id", "leaf", "place", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_a_leaf_tells_its_fields_apart(spark):
    rows = [(1, "é", None), (1, "é-", ""), (None, "1:", "é"), (12, "", "x" * 70_000)]
    df = spark.createDataFrame(rows, "a long, b string, c string")
    leaves = [r[0] for r in df.select(merkle.leaf_digest(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert leaves == [leaf_of(r) for r in rows] and len(set(leaves)) == 4


def test_manifest_of_hard_inputs(docs, texts):
    """Nulls, empty and long texts, ties and repeated rows, clashing column names."""
    rows = [((i, s, la, 0, t), None) for i, t, la, s in texts]
    result = merkle.manifest(docs)
    assert found(result) == brute(rows)
    assert all(r.verified and r.folded_root == r.root for r in result.collect())


@pytest.mark.parametrize("sizes", [[1], [16], [17], [256, 1], [257, 3, 1, 4097]])
def test_trees_of_every_shape(spark, sizes):
    rng, rows = random.Random(sum(sizes)), []
    for g, n in enumerate(sizes):
        rows += [((g * 10_000 + k, f"s{g}" if g else None, "en", k, rng.choice(string.ascii_letters) * 3), None) for k in range(n)]
    # Every seventh row is claimed to be another one.
    rows = [(f, leaf_of((*f[:4], f[4] + "!")) if k % 7 == 0 else None) for k, (f, _) in enumerate(rows)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*f, c) for f, c in rows], "doc_id long, source string, lang string, n_chars long, text string, claimed string").repartition(5)
    assert found(merkle.manifest(df, F.col("claimed"))) == brute(rows)


def test_many_groups(spark):
    """More groups than a block, so that their tree takes several rounds as well; a table of one row each."""
    rows = [((k, f"g{k % 700}", None, None, f"T{k}"), None) for k in range(900)]
    df = spark.createDataFrame([f for f, _ in rows], "doc_id long, source string, lang string, n_chars long, text string")
    assert found(merkle.manifest(df)) == brute(rows)


def test_repeated_rows_and_other_columns(spark):
    rows = [((7, "a", "en", 1, "same"), None)] * 40 + [((7, "a", "en", 1, "other"), None)]
    schema = "doc_id long, source string, lang string, n_chars long, text string, digest string, tree long, n string, place string, claim long, key long"
    df = spark.createDataFrame([(*f, "d", 3, "n", "p", 9, 8) for f, _ in rows], schema)
    assert found(merkle.manifest(df)) == brute(rows)


def test_empty_table(nothing):
    result = merkle.manifest(nothing)
    assert result.count() == 0 and "proof" in result.columns
    assert "proof" not in merkle.manifest(nothing, proofs=False).columns


def test_a_proof_holds_for_its_leaf_only():
    leaves = [hashlib.sha256(bytes([k])).digest() for k in range(200)]
    made = merkle.sweep_up(leaves, 2)
    assert [len(level) for level in made] == [200, 13, 1]
    for at, (suffix, shape) in enumerate(merkle.sweep_down(made, b"", b"")):
        assert merkle.fold(leaves[at], suffix, shape) == made[-1][0] != merkle.fold(leaves[at - 1], suffix, shape)
