"""The pipeline's stages, each against what its operator says of the stage's own input."""

import corpus_pipeline
from grafwerk.llm import decontaminate, mixing, near_dups, perplexity
from grafwerk.llm.common import fresh_path

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    inputs = []
    for _, stage in corpus_pipeline.STAGES:
        inputs.append(docs)
        path = fresh_path(spark, "stage")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if len(inputs) < 5:
            assert docs.columns == inputs[0].columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    assert ids(inputs[1]) == ids(perplexity.classify(inputs[0], labels).filter("kept"))
    assert ids(inputs[2]) == ids(near_dups.groups(inputs[1]).filter("kept"))
    leaks = {r.doc_id for r in decontaminate.contaminated(inputs[2], benchmark).collect()}
    assert leaks and ids(inputs[3]) == sorted(set(ids(inputs[2])) - leaks)
    copies = {r.doc_id: r.copies for r in mixing.mix(inputs[3]).collect()}
    assert ids(inputs[4]) == sorted(i for i, c in copies.items() for _ in range(c))
    last = docs.orderBy("start").collect()
    assert [r.doc_id for r in last] == ids(inputs[4])
    assert all(a.start + a.n_tokens == b.start for a, b in zip(last, last[1:]))


def test_rows_without_and_with_repeated_ids(spark):
    """Rows are judged one by one: null ids don't pass, and one bad row drops no other with its id."""
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(None, leak), (7, leak), (7, good), (None, good + " end"), (3, good + " last"), (5, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", None, 0, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _row int")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted([(3, good + " last"), (5, ""), (5, ""), (7, leak)])
    clean = corpus_pipeline.decontamination(spark, docs, SF).collect()
    assert len(clean) == 5 and all(r.text != leak for r in clean)
    assert corpus_pipeline.mixture(spark, docs, SF).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), SF).count() == 0
