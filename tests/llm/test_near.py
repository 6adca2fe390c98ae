import itertools
import random
import re
import tracemalloc
import types

import pyarrow as pa
import pyarrow.compute

from tempora.functions import session
from tempora.llm import near
from tempora.llm.components import components
from tempora.llm.near import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """Links of all pairs, and components, by plain Python."""
    sets = []
    for _, text in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((doc_id, len(sets[i]), least[find(i)], doc_id == least[find(i)]) for i, (doc_id, _) in enumerate(rows))


def result(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in near_duplicates(df, **options).collect())


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passage = [r.choice(vocab) for _ in range(60)]
    rows = []
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.randint(6, 150))]
        for _ in range(r.randint(1, 14)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 30))):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            rows.append(" ".join(copy))
    for _ in range(60):
        rows.append(" ".join([r.choice(vocab) for _ in range(r.randint(2, 40))] + passage))
    r.shuffle(rows)
    return list(enumerate(rows))


def test_all_pairs(spark):
    rows = corpus(1)
    assert result(spark, rows) == brute(rows)


def test_small_blocks_and_levels(spark):
    rows = corpus(2)
    assert result(spark, rows, block=4, wide=8, most=2, broadcast_bytes=0) == brute(rows)
    assert result(spark, rows, block=3, wide=3, most=1, early=1, levels=2) == brute(rows)


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "One two"), (9, "one TWO"), (10, "one two three"), (3, "É a b c d"), (2, "é a b c d"), (11, "x " * 70000), (12, "x x x x x")]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []
    got = result(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (4, "a b c d e f")])
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (4, 2, 1, False)]
    assert near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")).filter("not kept").count() == 0


def test_repeated_ids_with_different_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (5, b), (7, b + " more"), (8, a + " more"), (9, "else " * 9)]
    got = result(spark, rows)
    assert [(r[0], r[2]) for r in got] == [(1, 1), (1, 1), (5, 1), (7, 1), (8, 1), (9, 9)]


def test_a_refused_pair_hides_no_other():
    size = near.BANDS * near.ROWS

    def sig(equal):
        x = near.np.arange(size, dtype=near.np.uint32).astype(near.np.uint8)
        x[equal:] += 100
        return near.np.concatenate([x, near.np.zeros(near.SKETCH, near.np.uint8)])

    sigs = near.np.stack([sig(size), sig(size * 92 // 100), sig(size * 81 // 100)])
    nodes, sizes = near.np.array([1, 2, 3]), near.np.array([90, 90, 90])
    every = {(int(a), int(b)) for x, y in near.agreeing(nodes, sizes, near.np.array([1, 1, 3]), sigs, 75, True) for a, b in zip(x, y)}
    assert {(min(p), max(p)) for p in every} == {(1, 3), (2, 3)}
    forest = [p for x, y in near.agreeing(nodes, sizes, nodes, sigs, 75, False) for p in zip(x.tolist(), y.tolist())]
    assert len(forest) == 2


def test_groups_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = corpus(4)
        assert result(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7, "k"), (2, "a b c d e f", 8, None)], "doc_id long, text string, n int, label string")
    assert sorted(tuple(r) for r in near_duplicates(df).collect()) == [(1, 2, 1, True), (2, 2, 1, False)]


def test_nodes_of_different_components_meet(spark):
    rows = [("k", i, 0 if i < 23 else i % 7 + 1, 0, 23, 40) for i in range(40)] + [("l", 1, 1, 1, 1, 2), ("l", 2, 2, 1, 1, 2)]
    live = spark.createDataFrame(rows, "key string, node long, label long, top long, top_nodes long, nodes long")
    groups = {}
    for r in near.dealt(live, 4, 4).select("key", "g", "node").collect():
        groups.setdefault((r.key, r.g), set()).add(r.node)
    met = {(k, a, b) for (k, _), g in groups.items() for a in g for b in g if a < b}
    label = {(r[0], r[1]): r[2] for r in rows}
    need = {(k, a, b) for (k, a) in label for (j, b) in label if j == k and a < b and label[k, a] != label[k, b]}
    assert need <= met
    assert max(map(len, groups.values())) < 23


def test_odd_sketches_bound_the_difference():
    rng = random.Random(5)
    for size in (0, 1, 5, 60, 900, 5000):
        a = near.shingles(" ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(size)))
        for share in (0, 0.02, 0.3, 1):
            gone = {x for x in a.tolist() if rng.random() < share}
            b = near.np.array(sorted({x for x in a.tolist() if x not in gone} | {rng.getrandbits(64) for _ in range(int(size * share))}), near.np.uint64)
            bits = near.np.bitwise_count(near.odd_sketch(a) ^ near.odd_sketch(b)).sum()
            assert bits <= len(set(a.tolist()) ^ set(b.tolist()))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2001, 2000), (2000, 2001), (5, 5), (None, 4)]
    links += [(rng.randint(3000, 3200), rng.randint(3000, 3200)) for _ in range(100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    table = spark.createDataFrame(links, "a long, b long")
    for per_task in (40, 250, 500_000):  # by contraction between many tasks, between a few, and in one
        assert {r.node: r.label for r in components(table, per_task).collect()} == {x: find(x) for x in root}
    assert components(table.filter("a > 9999")).count() == 0


def test_hashing_keeps_no_words():
    tracemalloc.start()
    for i in range(50):
        near.word_hashes(" ".join(f"{i}x{j}" for j in range(2000)))
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 2_000_000  # 100,000 distinct words


def test_a_task_gives_back_what_it_doesnt_use():
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.compute.add(batch.column(0), 1)], names=["x"])

    pool, given = pa.default_memory_pool(), []
    release = session.pa.default_memory_pool
    session.pa.default_memory_pool = lambda: types.SimpleNamespace(release_unused=lambda: given.append(pool))
    try:
        out = list(session.freed(run)(iter([pa.RecordBatch.from_arrays([pa.array([1, 2])], names=["x"])])))
    finally:
        session.pa.default_memory_pool = release
    assert out[0].column(0).to_pylist() == [2, 3] and len(given) == 1


def test_a_freed_task_drops_the_tokenizer():
    """Before, a worker that had packed documents kept the tokenizer and its table of words for good."""
    import public_tokenizers

    from tempora.llm.encoder import encoder

    path, text = public_tokenizers.path("byte_bpe_50k.json"), ["One two, three."]
    first = encoder(path).encode(text)
    assert encoder.cache_info().currsize
    assert list(session.freed(lambda batches: batches)(iter([1, 2]))) == [1, 2]
    assert not encoder.cache_info().currsize and encoder(path).encode(text) == first
