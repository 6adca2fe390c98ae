import re

import pytest

from tempora.plans import q_text


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


TEXTS = ["ab " * 120, "Ab, " * 120 + "xyz", "cd " * 130 + "ab", "ab " * 100 + "cd " * 400, "", "ab " * 110 + "tail", None, "ab"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("turns"))
    rows = [(1, i, "user", x) for i, x in enumerate(TEXTS)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def test_whole_turns(spark, folder):
    plain = [None if x is None else re.sub("[^a-z0-9]+", "", x.lower()) for x in TEXTS]
    pairs = {i: (a, b) for i, (a, b) in enumerate(zip(plain, plain[1:])) if b is not None}
    rate = {i: None if a is None else distance(a, b) / max(len(a), 1) for i, (a, b) in pairs.items()}
    got = {r.turn: r.cer for r in q_text.cer_pairs(spark, folder).collect()}
    assert set(got) == set(pairs)
    assert all(got[i] is None if x is None else abs(got[i] - x) < 1e-6 for i, x in rate.items())
    gross = {r.turn: r.gross for r in q_text.gross_mismatch(spark, folder).collect()}
    cleared = {r.turn: r.cleared for r in q_text.tail_cleared(spark, folder).collect()}
    for i, (a, b) in pairs.items():
        if a is not None:
            ratio = len(b) / len(a) if a else None
            assert gross[i] == (rate[i] > 0.5 or (ratio is not None and not 0.7 <= ratio <= 1.4))
            assert cleared[i] == (not a or b.endswith(a[-2:]))
