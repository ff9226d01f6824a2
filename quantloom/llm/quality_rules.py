"""Quality rules in a short-circuit cascade.

A rule rejects a document by measures of its text: counts of words, symbols, lines and
repeated windows. Each rule's cost and selectivity are estimated on a bounded sample; the rules
are then ordered by rejection per cost, and written as one conditional expression, so that a
document meets no rule after the first that rejects it, and a measure that only later rules
use is never taken of it. The order decides what work is done, not which documents are kept.
All measures are built-in column functions of one row's text.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

SAMPLE_ROWS = 1000  # rows on which costs and selectivities are estimated, about; the order alone depends on them
REPEATS = 2  # timings of a rule, the shortest of which counts
WINDOW = 3
WORD = r"[^\x20\x09-\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


@dataclass(frozen=True)
class Parts:
    """A text and what measures are taken of: its words, and its lines that have a word."""

    text: Column
    words: Column
    lines: Column


def parts(text: Column) -> Parts:
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    return Parts(text, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lines)


def _alike(key: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """The members of a sorted array that have the key of a neighbour."""

    def members(s: Column) -> Column:
        same = lambda x, y: F.coalesce(key(x) == key(y), F.lit(False))
        return F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))

    return members


def _repeated_words(words: Column) -> Column:
    """Words inside windows of three words that the text has twice or more.

    If all windows' hashes differ there are none. Else windows with equal 33 bits of hash are
    neighbours once these are sorted with the places in one number; they are compared as words by
    a second sort, and the places of what repeats are merged from left to right.
    """
    none = F.lit(0).cast("long")

    def count(w: Column) -> Column:
        def exact(candidates: Column) -> Column:
            at = F.transform(candidates, lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
            placed = F.array_sort(F.transform(at, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("w"), i.alias("at"))))
            starts = F.array_sort(F.transform(_let(placed, _alike(lambda x: x["w"])), lambda x: x["at"]))
            begin = F.struct(F.lit(0).alias("end"), none.alias("n"))
            return F.aggregate(starts, begin, lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n")))["n"]

        def hashed(hashes: Column) -> Column:
            packed = F.sort_array(F.transform(hashes, lambda h, i: F.shiftleft(h, 31).bitwiseOR(i.cast("long"))))
            candidates = _let(packed, _alike(lambda x: F.shiftright(x, 31)))
            return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(_let(candidates, exact))

        first = F.slice(w, F.lit(1), F.size(w) - (WINDOW - 1))
        return _let(F.transform(first, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), hashed)

    return F.when(F.size(words) < WINDOW, none).otherwise(_let(words, count))


def _ends_cut(line: Column) -> Column:
    return F.rtrim(line).endswith("...") | F.rtrim(line).endswith("…")


#: What rules and reports can use, each a count of a text without nulls.
MEASURES: dict[str, Callable[[Parts], Column]] = {
    "n_words": lambda p: F.size(p.words).cast("long"),
    "word_chars": lambda p: F.aggregate(p.words, F.lit(0).cast("long"), lambda n, w: n + F.length(w)),
    "n_symbols": lambda p: F.regexp_count(p.text, F.lit(r"[#*$%&|<>]")).cast("long"),
    "n_lines": lambda p: F.size(p.lines).cast("long"),
    "n_dup_lines": lambda p: (F.size(p.lines) - F.size(F.array_distinct(p.lines))).cast("long"),
    "n_repeat_words": lambda p: _repeated_words(p.words),
    "n_letter_words": lambda p: F.size(F.filter(p.words, lambda w: w.rlike(r"\p{L}"))).cast("long"),
    "n_capitals": lambda p: F.regexp_count(p.text, F.lit(r"\p{Lu}")).cast("long"),
    "n_bullets": lambda p: F.size(F.filter(p.lines, lambda line: line.rlike(r"^[\x20\x09]*[•‣●*-][\x20\x09]+[^\x20\x09-\x0D]"))).cast("long"),
    "n_ellipses": lambda p: F.size(F.filter(p.lines, _ends_cut)).cast("long"),
}


@dataclass(frozen=True)
class Rule:
    """Rejects where `rejects` holds; it gets a function that gives a measure by its name."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


#: Fewer than 50 words, or more than half of them in repeated windows.
BASE = (
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repeated_windows", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
)
#: Bounds that prose of any language keeps: mean word length, symbols and letters a word, capitals, repeated lines, lists, cut lines.
RULES = (
    *BASE,
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 15 * m("n_words"))),
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("repeated_lines", lambda m: 2 * m("n_dup_lines") > m("n_lines")),
    Rule("letters", lambda m: 10 * m("n_letter_words") < 8 * m("n_words")),
    Rule("capitals", lambda m: 10 * m("n_capitals") > 3 * m("word_chars")),
    Rule("bullets", lambda m: 10 * m("n_bullets") > 9 * m("n_lines")),
    Rule("ellipses", lambda m: 10 * m("n_ellipses") > 3 * m("n_lines")),
)


def _measure(of: Parts, known: dict[str, Column]) -> Callable[[str], Column]:
    return lambda name: known[name] if name in known else MEASURES[name](of)


def _with_parts(docs: DataFrame, report: tuple[str, ...]) -> tuple[DataFrame, Parts, dict[str, str]]:
    """`docs` with columns of the text, its words, its lines and the reported measures, and these columns' names."""
    names = {name: fresh(docs, name) for name in ("text_", "words_", "lines_", *report)}
    docs = docs.withColumn(names["text_"], F.coalesce(F.col("text"), F.lit("")))
    split = parts(F.col(names["text_"]))
    docs = docs.withColumns({names["words_"]: split.words, names["lines_"]: split.lines})
    of = Parts(*[F.col(names[x]) for x in ("text_", "words_", "lines_")])
    return docs.withColumns({names[name]: MEASURES[name](of) for name in report}) if report else docs, of, names


@dataclass(frozen=True)
class Estimate:
    """What a rule rejects, of the sample's rows, and its seconds there."""

    rule: Rule
    rejected: float
    seconds: float

    @property
    def worth(self) -> float:
        return self.rejected / self.seconds


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, known: tuple[str, ...] = (), sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """The rules with most rejection per cost first, from a stored sample of about `sample_rows` rows.

    Measures in `known` are columns of the sample already, so a rule on them costs a comparison.
    A rule's seconds are those of an aggregate of its verdicts, less those of one that counts rows
    only, at least a tenth of a millisecond. An empty sample keeps the rules in their order.
    """
    share = min(1.0, sample_rows / max(docs.count(), 1))
    sample, of, names = _with_parts(docs.select("text").sample(share, seed=11).limit(2 * sample_rows), known)
    sample = stored(sample.drop("text"), "rules-sample")
    measure = _measure(of, {name: F.col(names[name]) for name in known})

    def timed(verdict: Column) -> tuple[float, int, int]:
        best = float("inf")
        for _ in range(REPEATS):
            began = time.perf_counter()
            row = sample.agg(F.count(F.lit(1)), F.count_if(verdict)).first()
            best = min(best, time.perf_counter() - began)
        return best, row[0], row[1]

    idle = timed(F.lit(False))[0]
    found = []
    for rule in rules:
        seconds, rows, rejected = timed(rule.rejects(measure))
        found.append(Estimate(rule, rejected / max(rows, 1), max(seconds - idle, 1e-4)))
    return sorted(found, key=lambda e: -e.worth)  # stable: rules that reject nothing keep their order


def cascade(rules: list[Rule] | tuple[Rule, ...], measure: Callable[[str], Column]) -> Column:
    """The name of the first rule that rejects, or null; later rules aren't evaluated."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for rule in rules:
        chain = chain.when(rule.rejects(measure), rule.name)
    return chain


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, report: tuple[str, ...] = (), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of `docs` with `rejected_by`, the rule that rejected (null: kept), and the measures of `report`.

    Words and lines are split once for a row. Measures that are reported are taken of every row;
    all others only where the cascade comes to them. A null or empty text has no words; repeated rows are judged each; an empty
    table has no rows; other columns are kept, and new ones whose names clash get underscores in
    front. A row needs memory for some twenty times its text. If several rules reject a row, which of
    them is named depends on the estimates; that it is rejected doesn't.
    """
    order = [e.rule for e in estimate(docs, rules, report, sample_rows)]
    verdict = fresh(docs, "rejected_by")
    counted, of, names = _with_parts(docs, report)
    counted = counted.withColumn(verdict, cascade(order, _measure(of, {name: F.col(names[name]) for name in report})))
    return counted.drop(*[names[x] for x in ("text_", "words_", "lines_")])


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with the columns of `docs`; nulls, repeats and clashes are as in `judged`."""
    name = fresh(docs, "rejected_by")
    return judged(docs, rules, (), sample_rows).where(F.col(name).isNull()).drop(name)


def op13_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = judged(docs, RULES, counts)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select("doc_id", *counts, failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


OP13_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (
    SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
    FROM texts
),
windows AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM parts)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) AS v(d) GROUP BY r),
counts AS (
    SELECT p.r, doc_id, text, lines, len(words) AS n_words, len(array_to_string(words, '')) AS word_chars,
           len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
           len(list_filter(words, lambda w: regexp_matches(w, '\p{L}'))) AS n_letter_words,
           len(regexp_extract_all(text, '\p{Lu}')) AS n_capitals,
           len(regexp_extract_all(text, '(?m)^[\x20\x09]*[•‣●*-][\x20\x09]+[^\x20\x09-\x0D]')) AS n_bullets,
           len(list_filter(lines, lambda l: rtrim(l, ' ') LIKE '%...' OR rtrim(l, ' ') LIKE '%…')) AS n_ellipses
    FROM parts p LEFT JOIN repeats USING (r)
),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
            OR 10 * n_letter_words < 8 * n_words OR 10 * n_capitals > 3 * word_chars OR 10 * n_bullets > 9 * n_lines OR 10 * n_ellipses > 3 * n_lines) AS kept
FROM judged
"""
