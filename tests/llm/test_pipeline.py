"""The pipeline: stages keep the columns of documents, and each stage's decisions take effect."""

import random

import corpus_pipeline


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, sf).collect(), docs.schema)
        assert kept.columns == docs.columns, name
        counts.append(kept.count())
    assert counts[0] > counts[1] > counts[2] == counts[3]
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in kept.collect()}


def test_near_copies_and_passages(spark, sf):
    rnd = random.Random(1)
    words = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    one, passage = words(200), words(60)
    near = [*one[:100], "changed", *one[101:]]
    rows = [(1, one), (2, near), (3, one), (4, words(80) + passage + words(80)), (5, words(80) + passage + words(90)), (6, words(150))]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", len(" ".join(w))) for i, w in rows], spark.read.parquet(f"{sf}/documents.parquet").schema)
    kept = corpus_pipeline.keep_one_of_each(spark, docs, sf)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6]
    left = {r.doc_id: r.text for r in corpus_pipeline.drop_repeats(spark, kept, sf).collect()}
    assert " ".join(passage) not in left[4] and left[6] == " ".join(rows[5][1]) and left[1] == " ".join(one)
    assert left[4].startswith(" ".join(rows[3][1][:79]))


def test_null_and_repeated_ids(spark, sf):
    """One row of each group stays, whatever its id; other texts under the same id stay too."""
    rnd = random.Random(2)
    text = lambda: [f"w{rnd.randrange(5000)}" for _ in range(120)]
    near = lambda w, i: [*w[:i], "changed", *w[i + 1 :]]
    a, b, c, d = (text() for _ in range(4))
    rows = [(3, a), (None, near(a, 50)), (None, text()), (7, near(a, 60)), (7, text()), (8, b), (8, near(b, 40)), (8, b), (None, c), (None, near(c, 30)), (9, d), (9, d), (None, near(d, 1))]
    few = [(None, None), (None, ""), (10, ""), (10, ""), (11, " ")]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in rows] + [(i, t, "en", "s", 1) for i, t in few], spark.read.parquet(f"{sf}/documents.parquet").schema).repartition(3)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each(spark, docs, sf).collect()]
    texts = [" ".join(w) for _, w in rows]
    first = [x for x in kept if x[1] not in {t for _, t in few}]
    one_of = lambda i, *at: sum((i, texts[k]) in first for k in at) == 1
    assert (3, texts[0]) in first and (None, texts[2]) in first and (7, texts[4]) in first
    assert one_of(8, 5, 6) and one_of(None, 8, 9) and first.count((9, texts[10])) == 1 and len(first) == 6
    assert sorted(map(str, (x for x in kept if x not in first))) == sorted(map(str, few))
