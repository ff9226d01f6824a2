"""The pipeline's stages on awkward rows: nulls in any column, empty and very long texts and words, repeated
rows, empty tables, and extra columns named like the stages' own."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_operators import prose, words

import corpus_pipeline
from quantloom.llm.common import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["score", "_score", "contamination", "copies", "copy", "rate", "doc", "h", "turn", "wordless", "texthash", "id", "of", "lam", "start", "n_tokens", "Features"]
STAGES = dict(corpus_pipeline.STAGES)
PASSAGE = "seven quick benchmark words that nobody else would ever put in this very order today"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    out = [(i, prose(r, r.randint(60, 120)), "en", r.choice(["a", "b", None]), 0) for i in range(60)]
    out += [(60 + i, "BUY NOW!! " * 40 if i % 2 else "word " * 90, "en", "a", 0) for i in range(40)]
    long_words = prose(r, 80) + " " + "x" * 70_000 + " " + "ab" * 5_000
    out += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, " \n\t", None, "a", 0), (203, prose(r, 40_000), "en", "b", 0), (204, long_words, "en", "b", 0)]
    out += [out[0], out[0], out[100]]  # repeated rows
    out += [(None, out[1][1], "en", "a", 0), (None, prose(r, 90), "en", "a", 0), (None, None, None, None, None), (None, "", "en", None, 0)]
    out += [(205, PASSAGE, "en", "b", 0), (None, PASSAGE + " indeed", "en", "b", None), (206, prose(r, 2000) + " " + PASSAGE, "en", "b", 0)]
    return out


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    labels = [(i, int(i < 60), 0) for i in range(100)] + [(5, None, 0), (None, 1, 0), (9999, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    items = [(1, PASSAGE), (2, None), (None, ""), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def clash(table):
    return table.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


def content(table):
    return Counter(tuple(r) for r in table.select("doc_id", "text", "lang", "source", "n_chars").collect())


def expect(name, rows, got):
    """What must hold of a stage's rows, by hand."""
    if name == "quality classifier":
        good = {r for r in rows if r[0] is not None and r[0] < 60}
        junk = {r for r in rows if r[0] is not None and 60 <= r[0] < 100}
        assert all(got[r] == rows.count(r) for r in good) and not any(got[r] for r in junk)
        assert all(got[r] in (0, rows.count(r)) for r in rows)
    if name == "near-duplicates":
        empty = [r for r in rows if not words(r[1])]
        assert all(got[r] == empty.count(r) for r in empty)
        assert got[rows[0]] == 1 and got[rows[1]] == 1
        assert not any(r[0] is None and r[1] == rows[1][1] for r in got)
        assert sum(n for r, n in got.items() if r[1] and r[1].startswith("BUY")) == 1
    if name == "benchmark decontamination":
        assert got == Counter(r for r in rows if not (r[1] and r[1].startswith(PASSAGE)))
    if name == "source mixing":
        for r in rows:
            assert got[r] <= 3 * rows.count(r)
            assert words(r[1]) or got[r] == rows.count(r)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stage(spark, sf, docs, rows, name):
    plain = STAGES[name](spark, docs, sf)
    assert plain.columns == docs.columns and plain.schema["doc_id"].dataType.simpleString() == "bigint"
    got = content(plain)
    assert set(got) <= set(rows)
    expect(name, rows, got)
    wide = clash(docs)
    again = stored(STAGES[name](spark, wide, sf), "clashing")
    assert again.columns == wide.columns
    assert all(again.where(F.col(c) != f"own {c}").count() == 0 for c in CLASHING[:3])
    assert content(again) == got


def test_token_stage(spark, sf, docs, rows):
    got = STAGES["token files"](spark, clash(docs), sf).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert sum(r["n_tokens"] == 1 for r in got) == sum(not r[1] for r in rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_of_an_empty_table(spark, sf, docs, name):
    assert STAGES[name](spark, docs.limit(0), sf).count() == 0


def test_stages_of_an_empty_benchmark_and_no_labels(spark, sf, docs, rows, tmp_path):
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    for name in ("quality classifier", "benchmark decontamination"):
        assert content(STAGES[name](spark, docs, str(tmp_path))) == Counter(rows)


def test_run(spark, sf, docs, tmp_path):
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    clash(docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert set(got) & set(range(60)) and 205 not in got and not set(got) & set(range(60, 100))
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
