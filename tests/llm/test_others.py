import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tempora.functions.session import fresh
from tempora.llm import classifier, exact, host_rules, mixing, packing, token_output
from tempora.llm.textstats import base_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, kept string"
EDGES = [(3, None), (4, ""), (1, "a  b\n"), (2, "a b "), (7, "a b "), (7, "a b "), (9, "Long text. " * 9000), (None, "a b "), (5, "z\x0bz"), (6, "z z")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if i == 4 else "en", f"s{(i or 0) % 3}", 0, 1, "x") for i, t in EDGES], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def ids():
    t = Tokenizer.from_file(PATH)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_token_output(spark, docs, none, ids):
    path = fresh(spark, "test")
    manifest = token_output.write_tokens(docs, path, PATH, frame_bytes=4096)
    got = sorted(token_output.read_tokens(spark, path, manifest).collect(), key=lambda r: r.start)
    want = {(i, len(ids(t)) + 1, crc([*ids(t), 2])) for i, t in EDGES}
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == len(EDGES)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    assert [r.doc_id for r in got] == sorted((i for i, _ in EDGES), key=lambda i: -1 if i is None else i)
    # a reader takes the frames of one document only
    row = next(r for r in got if r.doc_id == 9)
    store, top = token_output.filesystem(path)
    name = manifest.filter(f"shard = {row.shard}").first().file
    with store.open_input_file(f"{top}/{name}") as f:
        shard = token_output.ShardReader(f)
        assert shard.tokens(row.place).tolist() == [*ids(EDGES[6][1]), 2]
    raw = bytearray(store.open_input_file(f"{top}/{name}").read())
    raw[10] ^= 1
    import io

    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    with pytest.raises(Exception):
        list(token_output.ShardReader(File(bytes(raw))).parts(0))
    path = fresh(spark, "test")
    assert token_output.read_tokens(spark, path, token_output.write_tokens(none, path, PATH)).count() == 0


def test_exact(docs, none):
    got = exact.content_sort(docs).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    for r in got:
        same = [i for i, t in EDGES if hashlib.sha256(norm(t).encode()).hexdigest() == r.text_sha256]
        assert (r.keep_id, r.group_size) == (min(i for i in same if i is not None), len(same))
    assert len(got) == len(EDGES) and sum(r.kept for r in got) == len({norm(t) for _, t in EDGES})
    kept = exact.exact_keep(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.keep_id for r in got if r.kept)
    assert exact.content_sort(none).count() == exact.exact_keep(none).count() == 0


def test_exact_over_edges_of_partitions(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'one hot text' ELSE concat('t', id % 700) END AS text")
    got = {r.doc_id: r for r in exact.content_sort(df).collect()}
    assert got[2997].keep_id == 0 and got[2997].group_size == 1000
    assert sum(r.kept for r in got.values()) == 701 == exact.exact_keep(df).count()


def test_packing(docs, none, ids):
    got = packing.pack(docs, PATH).collect()
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    whole = [*ids(EDGES[6][1]), 0]
    mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == 9)
    assert [x[2] for x in mine[1:]] == [2048] * (len(mine) - 1) and sum(x[2] for x in mine) == len(whole)
    assert all(c == crc(whole[s : s + n]) for _, s, n, c in mine)
    assert packing.pack(none, PATH).count() == 0


def test_plans_fill_sequences():
    r = np.random.default_rng(1)
    hist = np.bincount(np.clip(r.gamma(2, 300, 60_000).astype(int) + 1, 1, 2048), minlength=2049)
    recipes = packing.plan(hist)
    made = np.zeros(2049, int)
    for lengths, n in recipes:
        assert sum(lengths) <= 2048 and n > 0
        np.add.at(made, list(lengths), n)
    assert (made == hist).all()
    least = -(-int((hist * np.arange(2049)).sum()) // 2048)
    assert sum(n for _, n in recipes) <= 1.01 * least


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_counts():
    for text in ("", "a b c a b c a", "x\nx\n x\n\n\n", "#* $ é\x1f ü\xa0y", "a a a a", "a b c d a b c", "one\r\ntwo\r\none\r\n"):
        c = base_counts(text)
        assert (c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_repeat_words"]) == brute_counts(text), text


def test_host_rules(spark, docs, none):
    got = {r.doc_id: r for r in host_rules.judged(docs).collect()}
    assert got[9].base_failed and not got[9].kept and got[3].n_words == 0
    assert host_rules.judged(none).count() == 0
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, good if i % 10 else "#### " * 60, "good") for i in range(100)] + [(1000 + i, good if i % 10 == 0 else "short", "bad") for i in range(100)] + [(2000, "short", "tiny")]
    r = {x.doc_id: x for x in host_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert r[1].kept and not r[0].kept and not r[1000].kept and not r[1000].base_failed  # its host is rejected
    assert r[2000].rate_base < 1


def test_classifier(spark, sf, docs, none):
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.learn(d, labels)
    got = {r.doc_id: r for r in classifier.scored(d, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    other = classifier.learn(d.repartition(7), labels.repartition(3))
    assert [t.tolist() for t in other.tables] == [t.tolist() for t in model.tables]
    assert classifier.scored(docs, model).count() == len(EDGES) and classifier.scored(none, model).count() == 0
    assert classifier.good(docs, model).columns == docs.columns
    assert classifier.learn(none, labels.limit(0)).score(np.zeros((2, len(classifier.FEATURES)))).tolist() == [0.5, 0.5]


def test_held_out_accuracy(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = classifier.scored(d, classifier.learn(d, labels)).filter("held_out").join(labels, "doc_id").select("quality", "predicted").collect()
    assert np.mean([r.quality == r.predicted for r in rows]) > 0.95


def test_mixing(docs, none):
    got = mixing.mixed(docs).collect()
    assert len(got) == len(EDGES) and not any(r.kept for r in got if not r.n_tokens)
    assert mixing.sampled(docs).columns == docs.columns
    assert mixing.mixed(none).count() == mixing.sampled(none).count() == 0


def test_raking_meets_targets(spark):
    rows = [(i, "w " * (20 + i % 50), ["en", "fr", None][i % 7 % 3], f"s{i % 5 * (i % 3)}") for i in range(600)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas()
    cells = got.drop_duplicates(["source", "lang", "topic"])
    share = got.groupby("source").n_tokens.sum() / got.n_tokens.sum()
    goal = share**0.7 / (share**0.7).sum()
    assert abs(cells.groupby("source").weight.sum() - goal).max() < 1e-3


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        got = {r.doc_id for r in out.select("doc_id").collect()}
        assert got <= ids and got
        if name != "packing":
            assert out.columns == docs.columns
        path = fresh(spark, "stage")
        out.write.parquet(path)
        docs, ids = spark.read.parquet(path), got


def test_words_are_learned_as_they_come():
    import public_tokenizers

    from tempora.llm.encoder import Encoder

    enc = Encoder(public_tokenizers.path("byte_bpe_50k.json"), keep=5)
    texts = ["One two, three.\nFour café. x1 one-two\nnatural", "", " a", "a\tb", "a  b", "the end.\nthe, the. a, .", "1. 你好, <|endoftext|>", "<|endoftext|>", *(f"w{chr(97 + i)} w{chr(98 + i)}," for i in range(20))]
    assert [enc.encode([t])[0] for t in texts] == [enc.whole(t) for t in texts] == enc.encode(texts)
    assert len(enc.words) <= 8 and len(enc.words.old) <= 8  # what is learned in one word's look-up goes beyond by two


def test_packing_writes_counts_in_few_files(spark, docs, monkeypatch):
    """Before, both small tables were written by as many tasks as there are shuffle partitions, each with its files and processes."""
    written = {}
    monkeypatch.setattr(packing, "cut", lambda df, tag, f=packing.cut: written.setdefault(tag, f(df, tag)))
    want = sorted((str(r) for r in packing.pack(docs, PATH).collect()))
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    old = {c: spark.conf.get(c) for c in names}
    try:
        for c, v in zip(names, ("40", "false"), strict=True):
            spark.conf.set(c, v)
        written.clear()
        got = sorted((str(r) for r in packing.pack(docs, PATH).collect()))
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert got == want
    assert {t: len(written[t].inputFiles()) for t in ("counts", "bases")} == {"counts": 1, "bases": 1}
