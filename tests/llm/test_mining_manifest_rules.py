"""Hard negatives, Merkle manifests and rule cascades against brute force, on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import hard_negatives, merkle, quality_rules

VECTORS = "vec_id long, embedding array<float>, label int, low string, block long"


def mined_by_hand(rows, one_in=100, positives=5, negatives=10):
    """(anchor, positive, rank, negative, scores) of rows (vec_id, vector, label) by comparing all of them."""
    rows = [(i, [math.floor(256 * float(x)) for x in v], lab) for i, v, lab in rows]
    out = []
    for i, v, lab in rows:
        if i % one_in:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, w, other in rows if j != i]
        for p, pid, _ in sorted([s for s in scored if s[2] == lab], key=lambda s: (-s[0], s[1]))[:positives]:
            inside = sorted([s for s in scored if s[2] != lab and 30 * p <= 100 * s[0] <= 90 * p], key=lambda s: (-s[0], s[1]))[:negatives]
            out += [(i, pid, k, nid, p, n) for k, (n, nid, _) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], VECTORS).repartition(5)
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(frame, **options).collect())


def as_float32(v):
    return [float(np.float32(x)) for x in v]


def test_hard_negatives_on_awkward_rows(spark):
    r = np.random.default_rng(5)
    rows = [(i, as_float32(r.normal(0.1, 0.3, 6)), int(r.integers(0, 3))) for i in range(700)]
    rows += [(700 + i, rows[100][1], i % 3) for i in range(60)]  # copies of an anchor's vector: ties
    rows += [rows[200], rows[200], rows[5]]  # repeated rows, an anchor's among them
    rows += [(800, [0.0] * 6, 1), (900, as_float32([-9.5] * 6), 2), (-100, as_float32(r.normal(0, 1, 6)), 1)]
    good = list(rows)
    rows += [(1000, None, 1), (1001, [0.1] * 5 + [None], 1), (1002, [0.1] * 5 + [float("nan")], 1), (1003, [0.1] * 5 + [float("inf")], 2), (1004, [0.1] * 6, None), (None, [0.1] * 6, 1), (1100, [], 0), (1200, [0.5] * 5, 0)]
    assert mined(spark, rows) == mined_by_hand(good)


def test_hard_negatives_of_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0, 0.0], 1)]) == []
    assert mined(spark, [(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2)]) == [(100, 1, 1, 2, 65536, 32768)]
    assert mined(spark, [(3, [1.0, 0.0], 1), (1, [1.0, 0.0], 2)]) == []  # no anchor
    with pytest.raises(OverflowError):
        mined(spark, [(100, [1e12, 0.0], 1)])


def test_scores_beyond_exact_doubles(spark):
    r = np.random.default_rng(2)
    rows = [(i * 10, as_float32(r.normal(0, 80_000, 4)), int(i % 2)) for i in range(120)]
    assert mined(spark, rows) == mined_by_hand(rows)


def test_clusters_leave_most_blocks_unread(spark, monkeypatch):
    r = np.random.default_rng(3)
    centers = r.normal(0, 1, (40, 8))
    rows = [(i, as_float32(centers[i % 40] + r.normal(0, 0.02, 8)), int(i % 40) % 4) for i in range(4000)]
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 50)
    chosen = []
    choose = hard_negatives.Search.choose

    def counted(self, asks, same, home=None):
        out = choose(self, asks, same, home)
        if home is None:
            read = sum(bin(int.from_bytes(bytes(x[0]), "big")).count("1") for x in out.select("need").collect())
            chosen.append(read / (asks.count() * self.zones.count()))
        return out

    monkeypatch.setattr(hard_negatives.Search, "choose", counted)
    assert mined(spark, rows) == mined_by_hand(rows)
    assert len(chosen) == 2 and chosen[0] < 0.1 and chosen[1] < 0.4


def test_hilbert_neighbours_touch():
    for n, bits in ((2, 3), (3, 2), (4, 2), (2, 1)):
        cells = np.array(np.meshgrid(*[range(1 << bits)] * n)).reshape(n, -1).T
        keys = [tuple(k) for k in hard_negatives.hilbert_keys(cells, bits)]
        along = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert len(set(keys)) == len(cells) and (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def written(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def manifest_by_hand(rows):
    """(doc_id, leaf, subroot, root, proof) of rows in the order of FIELDS; nulls sort first."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, sha(*map(written, row)), row[0]))

    def tree(nodes):
        """Root and each leaf's siblings."""
        proofs, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for leaf, i in enumerate(at):
                proofs[leaf] += nodes[i ^ 1 : (i ^ 1) + 1]
                at[leaf] = i // 2
            nodes = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        return nodes[0], proofs

    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in order}
    root, crowns = tree([trees[g][0] for g in order]) if order else (None, [])
    out = []
    for g, crown in zip(order, crowns, strict=True):
        for x, proof in zip(sorted(groups[g]), trees[g][1], strict=True):
            out.append((x[3], x[2], trees[g][0], root, sha(*proof, *crown)))
    return out


@pytest.mark.parametrize("sizes", [{"en": 700, "fr": 257, None: 3, "": 1, "zz": 2}, {"en": 1}, {"en": 5, "é": 6}, {}])
def test_merkle_manifest(spark, tmp_path, sizes):
    r = random.Random(4)
    rows = [(i + 1000 * k, r.choice(["a", "b:1", None]), lang, r.choice([i, None]), r.choice(["", "ü" * r.randrange(9), None, "2:xy"])) for k, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    if len(rows) > 100:
        rows += [rows[0], rows[0], (None, "a", "en", 1, "x"), (None, "a", "en", 2, "y"), (7, "other", "en", 9, "same id")]
        rows += [(5, "s", "fr", 1 << 62, "copies")] * 400
    r.shuffle(rows)
    spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, place int").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    found = merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted((tuple(x)[:5] for x in found), key=key) == sorted(manifest_by_hand(rows), key=key)
    import zlib

    chars = defaultdict(set)
    for d, *_, n, _t in rows:
        chars[d].add(n)
    for x in found:
        tampered = x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 7 == 0 and None not in chars[x["doc_id"]]
        assert x["verified"] == (x["folded_root"] == x["root"])
        if None not in chars[x["doc_id"]]:
            assert x["verified"] == (not tampered)


def rules_by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if windows[w[i], w[i + 1], w[i + 2]] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(9)
    some = lambda n: " ".join(r.choice("the river of stone runs to a quay and back".split()) + r.choice(["", "x", "y", "z1"]) for _ in range(n))
    clean = " ".join(f"word{chr(97 + i % 26)}{i}" for i in range(90))
    return [
        None, "", " \t\n\x0b\x0c\r ", "one", "one two", "a b c", "a b c a b c", "a a a a", "a a a a a a", "x\ny\nx\n\n \nx \nx", "é b 😀😀 😀", "#*$%&|<> # a|b",
        clean, clean + "\n" + clean, "\n".join([clean[:200]] * 3), clean.upper(), " ".join(["12"] * 30 + clean.split()[:60]), "\n".join(f"- {some(9)}" for _ in range(12)), "\n".join(f"{some(12)}... " for _ in range(9)),
        "w" * 50_000, some(30_000), *[some(r.randint(1, 200)) for _ in range(60)],
    ]


def test_quality_rules(spark, tmp_path, texts):
    rows = [(i, t, "words", 3) for i, t in enumerate(texts)] + [(0, texts[12], "again", 1), (None, texts[12], None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_words string, text_ int").repartition(4)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = quality_rules.op13_quality_rules(spark, str(tmp_path)).collect()
    shown = [(x["doc_id"], x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) for x in found]
    want = []
    for d, t, *_ in rows:
        n = rules_by_hand(t)
        want.append((d, *n, n[0] < 50 or 100 * n[4] > 50 * n[0]))
    assert sorted(map(str, shown)) == sorted(map(str, want))
    kept = {x["doc_id"] for x in found if x["kept"]}
    assert all(not x["kept"] for x in found if x["base_failed"])
    assert 12 in kept and not kept & {15, 16, 17, 18, 19}  # capitals, numbers, a list, cut lines, one word

    out = quality_rules.filter_documents(frame)
    assert out.columns == frame.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(x["doc_id"]) for x in found if x["kept"])
    named = quality_rules.judged(frame, report=("n_words",))
    assert named.columns == [*frame.columns, "_n_words", "rejected_by"]
    assert {r["rejected_by"] for r in named.where("doc_id = 15").collect()} == {"capitals"}
    assert quality_rules.judged(frame.limit(0), report=("n_words",)).count() == 0


def test_the_cascade_stops_at_the_first_rejection(spark):
    fails = quality_rules.Rule("fails", lambda m: F.raise_error(F.lit("evaluated")).cast("boolean"))
    few = quality_rules.Rule("few", lambda m: m("n_words") < 50)
    rows = spark.createDataFrame([("a b",), (None,)], "text string").repartition(2)
    of = quality_rules.parts(F.coalesce(F.col("text"), F.lit("")))
    chain = lambda *rules: rows.select(quality_rules.cascade(rules, lambda name: quality_rules.MEASURES[name](of)).alias("by"))
    assert [r["by"] for r in chain(few, fails).collect()] == ["few", "few"]
    with pytest.raises(Exception, match="evaluated"):
        chain(fails, few).collect()


def test_rules_are_ordered_by_rejection_per_cost(spark):
    slow = quality_rules.Rule("slow", lambda m: (m("n_repeat_words") < 0) | (F.length(F.sha2(F.repeat("text_", 3000), 512)) < 0) | (m("n_words") > 5))
    fast = quality_rules.Rule("fast", lambda m: m("n_words") > 5)
    idle = quality_rules.Rule("idle", lambda m: m("n_words") < 0)
    docs = spark.createDataFrame([(f"a b c d e f {i}" * 4,) for i in range(300)], "text string")
    order = quality_rules.estimate(docs, (slow, idle, fast))
    assert [e.rule.name for e in order] == ["fast", "slow", "idle"]
    assert order[0].rejected == order[1].rejected == 1 and order[2].rejected == 0 and order[0].seconds < order[1].seconds
