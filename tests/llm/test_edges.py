import numpy as np
import public_tokenizers
import pytest

from tempora.functions.session import fresh
from tempora.llm import classifier, edit_counts, mixing, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, kept string, row long, component_id long, n int"
PROSE = "The quick brown fox jumps over the lazy dog and runs away through the green forest until night falls. " * 4


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(1, PROSE), (2, PROSE + " "), (3, PROSE.replace("fox", "cat", 1)), (4, None), (5, ""), (5, "other text of an id"), (None, "no id here"), (7, "w " * 40_000), (8, "A line of its own, quite short."), (8, "A line of its own, quite short.")]
    path = str(tmp_path_factory.mktemp("edges"))
    docs = spark.createDataFrame([(i, t, None if i == 8 else "en", None if i == 3 else "s", 0, "x", None, 1, 2, 3) for i, t in rows], SCHEMA)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    empty = str(tmp_path_factory.mktemp("empty"))
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    return path, empty


def test_pipeline_takes_any_rows(spark, folder):
    import corpus_pipeline

    for sf in folder:
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name != "packing":
                assert out.columns == names
            path = fresh(spark, "edges")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            ids = [r.doc_id for r in docs.select("doc_id").collect()]
            if name == "near dedup" and sf == folder[0]:
                assert sorted(i for i in ids if i is not None) == [1, 4, 5, 7, 8]  # 2 and 3 are copies of 1, one of the texts of 5 is empty as 4 is
            assert ids == [] or sf == folder[0]


def test_labels_of_any_kind(spark):
    docs = spark.createDataFrame([(i, PROSE if i % 2 else "@@ ## $$ " * 9) for i in range(60)], "doc_id long, text string")
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    several = classifier.learn(docs, label([(i, i % 2) for i in range(60)] + [(i, i % 2) for i in range(30)] + [(3, None), (None, 1)]))
    got = {r.doc_id: r.predicted for r in classifier.scored(docs, several).collect()}
    assert np.mean([got[i] == i % 2 for i in range(60)]) > 0.9
    one = classifier.scored(docs, classifier.learn(docs, label([(i, 1) for i in range(60)]))).collect()
    assert all(0 <= r.score <= 1 and r.predicted == 1 for r in one)
    many = classifier.scored(docs.union(docs), classifier.learn(docs.union(docs), label([(1, 0), (1, 1)])))
    assert many.count() == 120


def test_packing_of_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c"), (3, "x y"), (3, "x y"), (4, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in got) == [(0, 0, 4), (3, 0, 3), (3, 0, 3), (4, 0, 1)]
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert places[0][1] == 0 and all(b[1] == a[1] + a[2] for a, b in zip(places, places[1:], strict=False) if a[0] == b[0])


def test_topics_of_a_column(spark):
    rows = [(i, "w " * 10, "en", "s", "news" if i % 2 else None) for i in range(20)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")).collect()
    assert {r.topic for r in got} == {"news", "\x00"}


def test_edit_counts_of_repeated_rows(spark):
    rows = [(1, "a b", [(0, 1, "c d")]), (1, "a b", [(0, 1, "c d")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<at:long,remove:long,insert:string>>")
    got = edit_counts.edited_counts(df, PATH, public_tokenizers.PATTERN).collect()
    assert [(r.n_tokens, r.n_tokens_edited) for r in got] == [(2, 3), (2, 3)]
