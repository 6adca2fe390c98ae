from tempora.llm import mixing


def expected(spark, cells, **options):
    """Expected tokens by cell, from documents of ten words."""
    rows, of = [], {}
    for (source, lang), docs in cells.items():
        for _ in range(docs):
            of[len(rows)] = (source, lang)
            rows.append((len(rows), "w " * 10, lang, source))
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), **options).collect()
    assert len(got) == len(rows) and all(0 <= r.probability <= 1 for r in got)
    out = dict.fromkeys(cells, 0.0)
    for r in got:
        out[of[r.doc_id]] += r.n_tokens * r.probability
    return out, {r.probability for r in got}


def shares(cells, dim):
    out = {}
    for key, n in cells.items():
        out[key[dim]] = out.get(key[dim], 0) + n
    return {x: n / sum(cells.values()) for x, n in out.items()}


def test_expected_shares_meet_targets(spark):
    cells = {("a", "en"): 1000, ("a", "fr"): 60, ("b", "en"): 150, ("b", "fr"): 260, ("c", "en"): 200, ("c", "fr"): 25}
    got, chances = expected(spark, cells, budget=0.7, sweeps=24)
    assert 1.0 in chances
    assert abs(sum(got.values()) - 7 * sum(cells.values())) < 1
    for dim in (0, 1):
        goal = {x: s**0.7 for x, s in shares(cells, dim).items()}
        for x, s in shares(got, dim).items():
            assert abs(s - goal[x] / sum(goal.values())) < 1e-3


def test_short_values_are_kept_whole(spark):
    cells = {("a", "en"): 900, ("b", "en"): 90, ("c", "en"): 10}
    got, _ = expected(spark, cells, budget=0.9)
    assert abs(sum(got.values()) - 9000) < 1
    assert abs(got["b", "en"] - 900) < 1 and abs(got["c", "en"] - 100) < 1
    everything, chances = expected(spark, cells, budget=1.0)
    assert chances == {1.0} and abs(sum(everything.values()) - 10000) < 1
