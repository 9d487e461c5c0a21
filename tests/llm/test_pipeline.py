"""The pipeline's stages, each against a plain version on what the stage before has kept."""

import re

from tests.llm.test_llm import DOC, jaccard_components, lined_corpus, passage_corpus, plain_passages, plain_statistics, plain_units

import corpus_pipeline
from ledgerlark.llm import line_dedup


def test_stages(spark):
    texts = lined_corpus() + [t for t in passage_corpus() if len(t or "") < 9000] + [" ".join(f"k{i}x{j}" for j in range(80)) for i in range(3)]
    texts += [texts[-1], texts[-1].replace("k2x5 ", "changed ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOC)
    stages = [f for _, f in corpus_pipeline.STAGES]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "substring dedup", "best-fit packing"]

    good = stages[0](spark, docs, "")
    rows = sorted((r.doc_id, r.text) for r in good.collect())
    for i, t in enumerate(texts):
        n, _, _, _, repeated = plain_statistics(t)
        if n < 50 or 100 * repeated > 50 * n:
            assert (i, t) not in rows
    assert {i for i, _ in rows} >= {len(texts) - k for k in range(1, 6)}

    def chunk(text):
        text = text.removesuffix("\n")
        return text if "\n" in text else None

    lined = stages[1](spark, spark.createDataFrame(good.collect(), good.schema), "")
    want = [(i, t) for i, t in plain_units(rows, lambda t: line_dedup.chunk_spans(t, (2, 2)), chunk) if t.strip()]
    assert sorted((r.doc_id, r.text) for r in lined.collect()) == sorted(want) and tuple(lined.columns) == corpus_pipeline.COLUMNS
    assert all(r.n_chars == len(r.text) for r in lined.collect())

    one = stages[2](spark, spark.createDataFrame(lined.collect(), lined.schema), "")
    kept = {i for i, _, c in jaccard_components(sorted(want)) if i == c}
    assert {r.doc_id for r in one.collect()} == kept
    rows = sorted((i, t) for i, t in want if i in kept)

    cut = stages[3](spark, spark.createDataFrame(one.collect(), one.schema), "")
    want = [(i, t) for i, t in plain_passages(rows) if t.strip()]
    assert sorted((r.doc_id, r.text) for r in cut.collect()) == sorted(want)

    packed = stages[4](spark, spark.createDataFrame(cut.collect(), cut.schema), "").collect()
    assert {r.doc_id for r in packed} == {i for i, _ in want}
    assert all(r.length <= 1024 for r in packed) and re.fullmatch(r"\d+", str(packed[0].sequence_id))


def test_each_row_has_its_own_verdict(spark):
    good = " ".join(f"a{j}" for j in range(80))
    rows = [(None, "three short words"), (None, good), (1, good), (1, "too short"), (2, good)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOC).repartition(3)
    kept = corpus_pipeline.keep_good(spark, docs, "")
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, good), (2, good), (None, good)], key=repr)
    assert tuple(kept.columns) == corpus_pipeline.COLUMNS


def test_near_duplicates_that_share_an_id(spark):
    one, two = (" ".join(f"{c}{j}" for j in range(80)) for c in "ab")
    rows = [(1, one), (2, one), (2, two), (3, two), (3, two), (4, None), (4, "x y"), (None, one), (None, one)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC).repartition(3)
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, one), (2, two), (4, None), (4, "x y"), (None, one), (None, one)], key=repr)
    assert tuple(kept.columns) == corpus_pipeline.COLUMNS


def test_empty(spark):
    docs = spark.createDataFrame([], DOC)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
