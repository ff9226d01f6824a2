"""The registered corpus queries and the pipeline's stages over the smallest tables, against DuckDB or brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_operators import LOWER, jaccard_components, words

import corpus_pipeline
from quantloom.llm import catalog, mixing, quality
from quantloom.llm.common import stored
from quantloom.llm.token_output import public_tokenizer

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return {d: t or "" for d, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}


@pytest.fixture(scope="module")
def got(spark):
    """The rows of a query, computed once."""
    known = {}

    def rows(name):
        if name not in known:
            known[name] = QUERIES[name](spark, SF).collect()
        return known[name]

    return rows


def crc_class(doc_id: int, classes: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % classes


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(got, duck, name):
    found = duck.execute(catalog.oracle_sql()[name])
    names = sorted(d[0] for d in found.description)
    places = [[d[0] for d in found.description].index(n) for n in names]
    assert names == sorted(got(name)[0].asDict())
    assert sorted(repr([r[n] for n in names]) for r in got(name)) == sorted(repr([r[i] for i in places]) for r in found.fetchall())


def test_op3(got, texts):
    # n-grams of three words over shorter ones over add-half unigrams, prior 100; start marks before a text
    tokens = {d: [*words(t), None] for d, t in texts.items()}

    def histories(w):
        marked = ["<s>", "<s>", *[("w", x) for x in w]]
        return [((marked[i + 1],), (marked[i], marked[i + 1])) for i in range(len(w))]

    uni, grams, history = Counter(), Counter(), Counter()
    for d, w in tokens.items():
        if crc_class(d, 5) != 1:
            uni.update(w)
            for hs, x in zip(histories(w), w, strict=True):
                grams.update((h, x) for h in hs)
                history.update(hs)
    n, v = sum(uni.values()), len(uni)
    rows = got("op3_language_model")
    assert len(rows) == len(texts)
    for r in rows:
        w, base, score = tokens[r["doc_id"]], 0.0, 0.0
        for hs, x in zip(histories(w), w, strict=True):
            p = (uni[x] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            for h in hs:
                p = (grams[h, x] + 100 * p) / (history[h] + 100)
            score += math.log10(p)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc_class(r["doc_id"], 5) == 1, len(w), sum(uni[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


def test_op5(got, texts):
    patterns = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    ]
    rows = got("op5_secrets")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        want = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(patterns) for m in p.finditer(texts[r["doc_id"]]) if ok(m))
        joined = [f"{patterns[k][0]}:{s}:{e}" for s, k, e in want]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in want) for i in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("random:")] == joined


def test_op6(got, texts, duck):
    rows = {r["doc_id"]: r for r in got("op6_quality")}
    assert sorted(rows) == sorted(texts)
    assert all(r["held_out"] == (crc_class(d, 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for d, r in rows.items())
    scores = defaultdict(list)
    for d, q in duck.execute("SELECT doc_id, quality FROM labels").fetchall():
        if rows[d]["held_out"]:
            scores[q].append(rows[d]["score"])
    above = [(a > b) + (a == b) / 2 for a in scores[1] for b in scores[0]]
    assert np.mean(above) > 0.9


def test_op6_scores_are_those_of_the_trees(spark, got):
    """Node by node and text by text, from trees fitted on the rows that may be learned from."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    trees = quality.learned(spark, SF, docs)
    assert len(trees.roots) > 1
    found = {r["doc_id"]: r["score"] for r in got("op6_quality")}
    rows = docs.collect()
    for r, x in zip(rows, quality.features(pa.array([r["text"] for r in rows], pa.string())), strict=True):
        total = trees.base
        for at in trees.roots:
            while trees.left[at] != at:
                at = (trees.left if x[trees.feature[at]] <= trees.threshold[at] else trees.right)[at]
            total += trees.value[at]
        assert found[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-9)


def token_rows(pairs):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(public_tokenizer())
    out, start = [], 0
    for d, t in sorted(pairs):
        ids = tool.encode(t, add_special_tokens=False).ids + [2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op7(got, texts):
    assert sorted(tuple(r) for r in got("op7_token_ids")) == token_rows(texts.items())


def test_op8(got, duck):
    data = {i: np.array(v, float) for i, v in duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall() if v is not None and None not in v}
    data = {i: v for i, v in data.items() if np.isfinite(v).all() and v.any()}
    found = defaultdict(list)
    for r in sorted(got("op8_nearest"), key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    assert set(found) == {i for i in data if i % 20 == 0}
    hits = total = 0
    for q, rows in found.items():
        want = sorted(((-float(v @ data[q]), i) for i, v in data.items() if i != q))[:20]
        assert len(rows) == len(want) and q not in dict(rows)
        assert all(s == pytest.approx(float(data[i] @ data[q]), rel=1e-12, abs=1e-12) for i, s in rows)
        assert rows == sorted(rows, key=lambda x: (-x[1], x[0]))
        hits, total = hits + len({i for _, i in want} & set(dict(rows))), total + len(want)
    assert hits / total >= 0.9


def mix_targets(sizes):
    """Shares by weights 1, 2, 3 in order of the sources, filled up to three times a source's size."""
    order = [*sorted(s for s in sizes if s is not None), *[s for s in sizes if s is None]]
    left, out, total = {s: i % 3 + 1 for i, s in enumerate(order)}, {}, sum(sizes.values())
    while True:
        rest = total - sum(out.values())
        over = [s for s in left if rest * left[s] / sum(left.values()) > 3 * sizes[s]]
        if not over:
            return out | {s: rest * w / sum(left.values()) for s, w in left.items()}
        for s in over:
            out[s] = 3 * sizes[s]
            del left[s]


def check_mix(found, rows):
    """`found` has size and taken by (source, doc_id) of `rows`, which are (doc_id, text, source)."""
    sizes, taken, largest = Counter(), Counter(), Counter()
    for d, t, s in rows:
        n = len(words(t))
        assert 0 <= found[s, d] <= 3 * n
        sizes[s] += n
        taken[s] += found[s, d]
        largest[s] = max(largest[s], n)
    goals = mix_targets(sizes)
    for s, goal in goals.items():
        assert abs(taken[s] - goal) <= 2 * largest[s]
    return sizes, goals


def test_op10(got, duck):
    rows = duck.execute("SELECT doc_id, text, source FROM documents").fetchall()
    source = {d: s for d, _, s in rows}
    found = got("op10_mix_sources")
    assert sorted(r["doc_id"] for r in found) == sorted(source)
    sizes, goals = check_mix({(source[r["doc_id"]], r["doc_id"]): r["taken"] for r in found}, rows)
    text = {d: t for d, t, _ in rows}
    for r in found:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (len(words(text[r["doc_id"]])), sizes[s]) and r["target"] == pytest.approx(goals[s])


def test_op10_rates_solve_the_dual(spark, duck):
    """Each source's multiplier by bisection; copies are the rates rounded up or down."""
    rows = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    for s, goal in mix_targets(sizes).items():
        own = [r for r in rows if r["source"] == s and r["size"]]
        n = np.array([r["size"] for r in own], float)
        rates = lambda lam: np.exp(np.minimum(lam * n, math.log(3)))  # noqa: E731, B023
        lo, hi = -100.0, 100.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if (rates(mid) * n).sum() >= goal else (mid, hi)
        want = np.full(len(n), 3.0) if goal >= 3 * sizes[s] else rates(hi)
        assert [r["rate"] for r in own] == pytest.approx(want.tolist(), rel=1e-4)
        assert all(math.floor(r["rate"] - 1e-6) <= r["copies"] <= math.ceil(r["rate"] + 1e-6) for r in own)


def test_pipeline(spark, got):
    """Each stage against brute force on its own input, and the whole run against the last stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    inputs = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, inputs[-1], SF), f"test-{name.replace(' ', '-')}")
        assert out.columns == docs.columns
        inputs.append(out)
    before = [[tuple(r) for r in x.select("doc_id", "text", "source").collect()] for x in inputs]
    ids = [sorted(r[0] for r in rows) for rows in before]

    assert ids[1] == sorted(r["doc_id"] for r in got("op6_quality") if r["predicted"] == 1)
    assert 0 < len(ids[1]) < len(ids[0])

    _, component = jaccard_components(before[1], 5)
    assert ids[2] == sorted({d for d, c in component.items() if d == c})
    assert len(ids[2]) < len(ids[1])

    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = set()
    for (t,) in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect():
        w = find(t)
        windows |= {tuple(w[j : j + 13]) for j in range(max(len(w) - 12, 1) if w else 0)}
    lengths, clean = {len(w) for w in windows}, []
    for d, t, _ in before[2]:
        w, hit = find(t), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit.update(range(j, j + n))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append(d)
    assert ids[3] == sorted(clean)
    assert len(ids[3]) < len(ids[2])

    times = Counter((r[2], r[0]) for r in before[4])
    assert {r[0] for r in before[4]} <= set(ids[3])
    check_mix({(s, d): times[s, d] * len(words(t)) for d, t, s in before[3]}, before[3])
    assert all(n <= math.ceil(mixing.LIMIT) for n in times.values())

    want = token_rows((d, t or "") for d, t, _ in before[4])
    assert sorted(tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, inputs[-1], SF).collect()) == want
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == want
