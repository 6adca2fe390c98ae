import random
import re

import pytest

from tempora.llm import host_rules

GOOD = " ".join(f"word{i}" for i in range(80))
MARKED = " ".join(f"word{i} #" for i in range(80))
SHORT = "too short"
LINES = "\n".join(["the same line of some words here again"] * 4 + [" ".join(f"w{i} long{i}" for i in range(60))])
TEXTS = [GOOD, MARKED, SHORT, LINES, None]


def plain(rows, limit=0.5, least=2.0):
    """Verdicts by plain Python, from the counts of the contract."""
    fails = {}
    for doc, text, host in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        again = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
        n, chars = len(words), sum(map(len, words))
        fails[doc] = (host, {
            "base": n < 50 or 100 * len(again) > 50 * n, "symbols": 10 * sum(c in "#*$%&|<>" for c in text) > max(n, 1),
            "lines": 10 * (len(lines) - len(set(lines))) > 3 * max(len(lines), 1), "length": chars < 3 * n or chars > 12 * n,
        })
    hosts = {}
    for host, f in fails.values():
        hosts.setdefault(host, []).append(f)
    rejected = set()
    total, h = len(fails), len(hosts)
    room = total - sum(len(x) ** 2 for x in hosts.values()) / total - (h - 1)
    for rule in ("base", "symbols", "lines", "length"):
        k = {x: sum(f[rule] for f in fs) for x, fs in hosts.items()}
        m = sum(k.values()) / total
        strength = 1e6
        if room > 1e-9 and 0 < m < 1:
            spread = sum(len(hosts[x]) * (k[x] / len(hosts[x]) - m) ** 2 for x in hosts)
            r = (spread / (m * (1 - m)) - (h - 1)) / room
            strength = 1 / r - 1 if r > 1e-6 else 1e6
        strength = max(strength, least)
        rejected |= {x for x in hosts if (k[x] + strength * m) / (len(hosts[x]) + strength) >= limit}
    return {doc: (f["base"], not f["base"] and host not in rejected) for doc, (host, f) in fails.items()}


def judged(spark, rows):
    got = host_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    return {r.doc_id: (r.base_failed, r.kept) for r in got}


@pytest.mark.parametrize("seed", range(4))
def test_verdicts_are_those_of_plain_python(spark, seed):
    r = random.Random(seed)
    rows = []
    for host in [*(f"h{i}" for i in range(25)), None]:
        weights = [r.choice([0, 1, 8]) + 0.1 for _ in TEXTS]
        rows += [(len(rows) + i, r.choices(TEXTS, weights)[0], host) for i in range(r.choice([1, 2, 9, 30]))]
    assert judged(spark, rows) == plain(rows)


def test_one_bad_text_rejects_no_host(spark):
    rows = [(i, MARKED if i % 4 == 0 else GOOD, f"h{i}") for i in range(200)]
    assert all(kept for _, kept in judged(spark, rows).values())


def test_edges(spark):
    assert host_rules.judged(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    rows = [(1, GOOD, None), (1, GOOD, None), (2, None, None), (None, MARKED * 3000, "x")]
    got = host_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted((r.doc_id or 0, r.base_failed, r.host, r.host_docs) for r in got.collect())[1:] == [(1, False, None, 3), (1, False, None, 3), (2, True, None, 3)]
