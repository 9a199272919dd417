"""The pipeline's stages on awkward rows, and its decisions on planted ones."""

import cases
import corpus_pipeline as pipeline
import pytest

ITEM = " ".join(cases.prose(300, 14).split())


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    """A small folder of tables: clean, toxic, copied, near-copied and contaminated documents."""
    path = tmp_path_factory.mktemp("tables")
    some, marks = [], []
    for i in range(150):
        words = cases.prose(2000 + i, 120).split(" ")
        toxic = i % 3 == 0
        for k in range(10 if toxic else 0):
            words.insert(11 * k + i % 9, "grobian" + cases.WORDS[k])
        some.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic)))
    clean, long = some[1][1], cases.prose(401, 200, 1000)
    some += [(500, clean), (501, "intro words\n" + clean), (502, long), (506, cases.edited(long, 90)), (503, cases.prose(400, 60) + " " + ITEM), (504, None), (505, "")]
    rows = [(i, t, "en", "s", None if t is None else len(t), *["c"] * 10) for i, t in some]
    cases.documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    cases.labels(spark, marks).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_are_in_the_given_order():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "encoding"]
    assert pipeline.ORACLE_SQL is None


def test_run_keeps_clean_documents_alone(spark, folder):
    got = {r.doc_id: r for r in pipeline.run(spark, folder).collect()}
    toxic = {i for i in range(150) if i % 3 == 0}
    assert len(toxic & got.keys()) <= 5  # a trained model judges
    clean = {i for i in range(150) if i % 3} | {502}
    assert len(clean - got.keys()) <= 3 and {504, 505} <= got.keys()
    assert not {500, 503, 506} & got.keys()
    assert got[504].n_tokens == got[505].n_tokens == 0


def test_stages_take_awkward_and_no_rows(spark, folder):
    for docs in (cases.documents(spark), cases.empty(spark)):
        for name, fn in pipeline.STAGES[:-1]:
            out = fn(spark, docs, folder)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count(), name
        assert pipeline.encoding(spark, docs, folder).count() == docs.count()


def test_line_dedup_stage_follows_n_chars(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in pipeline.line_dedup(spark, docs, folder).collect()}
    assert 500 not in got and got[501].text == "intro words\n" and got[501].n_chars == 12 and got[2].n_chars == len(got[2].text)


def test_subwords_of_many_words_take_little_room_beside_the_result():
    """The driver fits the toxicity model: what it holds for a moment counts against its memory."""
    import random
    import tracemalloc

    import numpy as np

    from convoy.llm import toxicity

    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 14))) for _ in range(40_000)]
    tracemalloc.start()
    try:
        flat, starts = toxicity.subwords(words)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4 * (flat.nbytes + starts.nbytes)
    one = [toxicity.subwords([w])[0] for w in words[9_990:10_010]]
    assert np.array_equal(np.concatenate(one), flat[starts[9_990] : starts[10_010]])
