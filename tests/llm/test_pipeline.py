import re
from collections import Counter, defaultdict

import corpus_pipeline
from daybook.llm import mixing, pieces, quality
from daybook.llm.neardup import near_copies
from test_mixing import filled
from test_neardup import expected

SF = "/root/testdata/sf0.01"


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "exact dedup", "near dedup", "source mix", "encoding"]
    columns = docs.columns

    def run(name, docs):
        out = stages[name](spark, docs, SF)
        assert name == "encoding" or out.columns == columns
        rows = out.collect()
        return rows, spark.createDataFrame(rows, out.schema)

    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    accepted = {r.doc_id for r in quality.scored(docs, model).filter("predicted = 1").collect()}
    rows, docs = run("quality classifier", docs)
    assert {r.doc_id for r in rows} == accepted and len(rows) == len(accepted)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert not any(labels.get(r.doc_id) == 0 for r in rows)

    best = {}
    for r in rows:
        content = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        best[content] = min(best.get(content, (1, 0)), (-len(r.text), r.doc_id))
    rows, docs = run("exact dedup", docs)
    assert sorted(r.doc_id for r in rows) == sorted(i for _, i in best.values())

    found = {r.doc_id: r.component_id for r in near_copies(docs, 5).collect()}
    component, _ = expected([(r.doc_id, r.text) for r in rows], 5)
    assert found == component
    rows, docs = run("near dedup", docs)
    assert sorted(r.doc_id for r in rows) == sorted(set(component.values()))

    size = {r.doc_id: len(r.text.encode().split()) for r in rows}
    of = {r.doc_id: r.source for r in rows}
    sizes = defaultdict(int)
    for i, n in size.items():
        sizes[of[i]] += n
    target = filled(sizes)
    rows, docs = run("source mix", docs)
    copies = Counter(r.doc_id for r in rows)
    assert max(copies.values()) <= 2
    taken = defaultdict(int)
    for i, n in copies.items():
        taken[of[i]] += n * size[i]
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in target)
    assert copies == {r.doc_id: r.copies for r in mixing.mix(spark.read.parquet(f"{SF}/documents.parquet").filter(f"doc_id IN ({','.join(map(str, of))})")).collect() if r.copies}

    rows, _ = run("encoding", docs)
    encoder, texts = pieces.Encoder(pieces.Vocabulary.load()), {r.doc_id: r.text for r in docs.collect()}
    assert Counter(r.doc_id for r in rows) == copies
    assert all(r.round_trip and r.ids == encoder.encode(texts[r.doc_id]).tolist() for r in rows)


def test_run_gives_the_stages_result(spark):
    small = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, small)
    assert rows.columns == ["doc_id", "n_ids", "round_trip", "ids"]
    assert 100 < rows.count() < 400 and rows.filter("NOT round_trip").count() == 0


def hard_table(spark, rows):
    """Rows with the columns of documents and others whose names the stages use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, name string, size long, row long, want long, node long, digest binary"
    return spark.createDataFrame([(i, t, la, s, 0, "k", "n", 7, 1, 2, 3, b"d") for i, t, la, s in rows], schema)


def test_stages_on_hard_inputs(spark, texts):
    """Nulls in any column, empty and long texts, ties, repeated rows and clashing names: every stage but the last gives the columns it
    got and rows that it got; the last a row per row."""
    docs = hard_table(spark, texts).repartition(3)
    given = {(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.count()
        out = stage(spark, docs, SF)
        if name == "encoding":
            assert out.count() == rows and out.filter("NOT round_trip").count() == 0
            continue
        assert out.columns == docs.columns
        kept = out.collect()
        assert {(r.doc_id, r.text, r.lang, r.source) for r in kept} <= given and (kept or name == "quality classifier")
        if kept:
            docs = spark.createDataFrame(kept, out.schema)


def test_stages_on_an_empty_table(spark):
    docs = hard_table(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and (name == "encoding" or out.columns == docs.columns)
