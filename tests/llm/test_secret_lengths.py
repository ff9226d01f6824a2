"""Random spans of all lengths that false-discovery control can pass, against a Python version."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import pytest
from test_operators import ALPHABETS, battery

from quantloom.llm import secrets

WORDS = ["internationalization", "counterrevolution", "interdisciplinary", "misunderstandings", "responsibilities", "characteristics", "acknowledgements", "INTERNATIONALLY", "straightforwardly"]


def level(p):
    return min(math.floor(-math.log10(max(p, 1e-30)) * 10), 300)


def stratum(encoding, n):
    return encoding, min(int(math.log2(n)), 12), n < 20


@pytest.mark.parametrize("rate", [0.01, 0.05])
def test_spans_of_every_length(spark, rate):
    r = random.Random(3)
    texts = []
    for i in range(600):
        size = r.randint(6, 26)
        alphabet = ALPHABETS[r.choice(["hex", "base32", "base64"])]
        key = "".join(r.sample(alphabet, min(size, len(alphabet)))) if i % 3 else "".join(r.choices(alphabet, k=size))
        texts.append(f"{r.choice(WORDS)} so {key} {r.choice(WORDS)[: r.randint(8, 20)]}" if i % 2 else f"of {key}, {key[::-1]}")
    found = {(i, m.start(), m.end()): battery(m[0]) for i, t in enumerate(texts) for m in re.finditer("[A-Za-z0-9+/_-]{2,}={0,2}", t)}
    # every run of two symbols and more counts here, so that nothing rests on where the operator starts
    strata = defaultdict(list)
    least = secrets.shortest(rate)
    for e, n, _, p in found.values():
        if n < least:
            assert p > rate
        else:
            strata[stratum(e, n)].append(level(p))
    limit = {key: min((b for b in set(bins) if 10 ** (-b / 10) * len(bins) <= rate * sum(x >= b for x in bins)), default=10**6) for key, bins in strata.items()}
    want = {span for span, (e, n, p_random, p) in found.items() if n >= least and p_random >= 0.001 and level(p) >= limit[stratum(e, n)]}
    base = {(i, m.start(), m.end()) for i, t in enumerate(texts) for m in re.finditer("AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", t)}
    rows = secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rate).collect()
    assert {(row["doc_id"], s["start"], s["end"]) for row in rows for s in row["spans"] if s["kind"] == 3} == want - base
    assert sum(end - start < 20 for _, start, end in want) > 20


@pytest.mark.parametrize("rate", [0.001, 0.01, 0.05])
def test_shorter_runs_cannot_be_discoveries(rate):
    n = secrets.shortest(rate)
    assert all(secrets.least_p(e, m) > rate for e in ALPHABETS for m in range(2, n))
    assert any(secrets.least_p(e, n) <= rate + 1e-6 for e in ALPHABETS)
    for e, alphabet in ALPHABETS.items():
        run = alphabet[:13]
        found = battery(run)
        if found[0] == e:
            assert found[3] == pytest.approx(secrets.least_p(e, 13))
