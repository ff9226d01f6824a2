"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

The patterns' spans are found in place: splitting a text at a pattern and extracting the
pattern's matches give the gaps and the matches in turn, whose lengths add up to positions.

The method adds long runs of an encoding's alphabet that look random. For each candidate
run the encoding is inferred (hex, base32, base64), and three tests compare it with uniform
symbols: chi-squared, runs about the middle symbol, and serial correlation. Cauchy's
combination of their p-values must not reject randomness. Whether the run may count as a
discovery is judged against text: under written language the chi-squared statistic is larger,
as its symbols coincide more often, with a spread that shrinks with the length; its lower
tail there is the p-value of a discovery, so short runs need stronger evidence. These are
controlled by Benjamini and Hochberg's procedure in each stratum of encoding and length
class, over a histogram of all candidates of the corpus, those that the tests reject included.

Candidates are runs of all lengths that can be discoveries at all: the procedure never passes a p-value above
its rate, and that of a run whose symbols all differ, the least that its length allows, falls with the length.
"""

from __future__ import annotations

import math
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# The patterns of the contract, in the order of the kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LONG = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8})"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a run that is too short holds no longer one
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+={0,2}"  # sought only where a run begins
# Rates at which two symbols of a text coincide, and sums of cubed symbol rates.
TEXT_COINCIDENCE = {"hex": 0.12, "base32": 0.0667, "base64": 0.0667}
TEXT_CUBES = {"hex": 0.018, "base32": 0.0054, "base64": 0.0054}
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
# Lengths below 20 are classes of their own, as nearly all of their runs are words.
SHORT_CLASS = 20
LEAST_RANDOM = 0.001  # a candidate whose combined tests reject randomness at this level is none
DISCOVERY_RATE = 0.01
BINS_A_DECADE, DECADES = 10, 30
SPAN_RUN = 1000  # spans of a text that are gathered at a time

_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _spans(text: Column, pattern: str, kind: int, value_group: int | None = None, least: int = 0, matches: Column | None = None) -> Column:
    """Spans (start, kind, end), in code points, of the leftmost non-overlapping matches (extracted here if not given)."""
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if matches is None else matches
    value = matches if value_group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    zipped = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), F.zip_with(matches, value, lambda m, v: F.struct(F.length(m).alias("n"), F.length(v).alias("v"))), lambda g, m: F.struct(F.length(g).alias("g"), m["n"].alias("n"), m["v"].alias("v")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        end = start + x["n"]
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        # full runs are put aside, as appending to all spans of a text with very many would copy them each time
        full = F.size(acc["spans"]) >= SPAN_RUN
        spans = F.when(full, one).otherwise(F.concat(acc["spans"], one))
        runs = F.when(full, F.concat(acc["runs"], F.array(acc["spans"]))).otherwise(acc["runs"])
        return F.when(x["v"] >= least, F.struct(end.alias("at"), spans.alias("spans"), runs.alias("runs"))).otherwise(F.struct(end.alias("at"), acc["spans"].alias("spans"), acc["runs"].alias("runs")))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("spans"), F.array().cast(f"array<{_SPAN}>").alias("runs"))
    return F.aggregate(zipped, begin, step, lambda acc: F.flatten(F.concat(acc["runs"], F.array(acc["spans"]))))


def least_p(encoding: str, n: int) -> float:
    """The p-value under written language of `n` symbols that all differ, which no run of that length is below."""
    text = TEXT_COINCIDENCE[encoding]
    var = 2 * text * (1 - text) / (n * (n - 1)) + 4 * (TEXT_CUBES[encoding] - text * text) / n
    return math.erfc(text / math.sqrt(2 * var)) / 2


def shortest(rate: float) -> int:
    """The shortest length at which a run of some encoding can be a discovery at `rate`."""
    return next(n for n in range(2, 1 << 20) if any(least_p(e, n) <= rate + 1e-6 for e in ALPHABETS))


def _normal_cdf(z: Column) -> Column:
    """Zelen and Severo's approximation, with an absolute error below 1e-7, and an exponential tail beyond 6."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    near = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    tail = F.when(a < 6, near).otherwise(F.exp(-a * a / 2) * 0.3989422804014327 / a)
    return F.when(z < 0, tail).otherwise(1 - tail)


def _cauchy(*p_values: Column) -> Column:
    """Cauchy's combination, which holds for dependent tests too."""
    heavy = [F.tan((0.5 - F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))) * math.pi) for p in p_values]
    return 0.5 - F.atan(reduce(lambda a, x: a + x, heavy) / len(heavy)) / math.pi


def _tests(run: Column, rate: float) -> Column:
    """encoding, n, p_text (chi-squared against written language) and, where that allows a discovery at `rate`,
    p_random (three tests against uniform symbols), which is null elsewhere."""
    limit = rate + 1e-6
    body = F.regexp_replace(F.translate(run, "-_", "+/"), "=+$", "")
    encoding = F.when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(body.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")

    def choose(values: dict) -> Column:
        return reduce(lambda c, kv: c.when(encoding == kv[0], kv[1]), list(values.items())[1:], F.when(encoding == next(iter(values)), next(iter(values.values()))))

    body = F.when(encoding == "hex", F.lower(body)).otherwise(body)
    n, k = F.length(body).cast("double"), choose({e: float(len(a)) for e, a in ALPHABETS.items()})
    alphabet = choose({e: a for e, a in ALPHABETS.items()})
    chars = F.filter(F.split(body, ""), lambda c: F.length(c) > 0)
    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    squares = total(F.transform(F.array_distinct(chars), lambda c: F.pow(n - F.length(F.replace(body, c, F.lit(""))), F.lit(2.0))))
    # in two steps, as every reference to a column would otherwise compute it again
    facts = F.struct(encoding.alias("encoding"), n.alias("n"), k.alias("k"), squares.alias("squares"), chars.alias("chars"), alphabet.alias("alphabet"))

    def judge(f: Column) -> Column:
        n, k = f["n"], f["k"]
        at = F.transform(f["chars"], lambda c: F.position(c, f["alphabet"]).cast("double") - 1)
        free = k - 1
        chi = f["squares"] * k / n - n
        p_chi = 1 - _normal_cdf((F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))
        high = total(F.transform(at, lambda x: F.when(x >= k / 2, 1.0).otherwise(0.0)))
        pairs = F.zip_with(F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at) - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        runs = 1 + total(F.transform(pairs, lambda p: F.when((p["x"] >= k / 2) != (p["y"] >= k / 2), 1.0).otherwise(0.0)))
        low = n - high
        mean_runs = 2 * high * low / n + 1
        var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
        p_runs = F.when(var_runs > 0, 2 * _normal_cdf(-F.abs(runs - mean_runs) / F.sqrt(F.greatest(var_runs, F.lit(1e-12))))).otherwise(0.0)
        middle, spread = (k - 1) / 2, (k * k - 1) / 12
        serial = total(F.transform(pairs, lambda p: (p["x"] - middle) * (p["y"] - middle))) / (spread * F.sqrt(n - 1))
        p_serial = 2 * _normal_cdf(-F.abs(serial))
        coincidence = (f["squares"] - n) / (n * (n - 1))
        text = reduce(lambda c, e: c.when(f["encoding"] == e, TEXT_COINCIDENCE[e]), list(ALPHABETS)[1:], F.when(f["encoding"] == "hex", TEXT_COINCIDENCE["hex"]))
        cubes = reduce(lambda c, e: c.when(f["encoding"] == e, TEXT_CUBES[e]), list(ALPHABETS)[1:], F.when(f["encoding"] == "hex", TEXT_CUBES["hex"]))
        var = 2 * text * (1 - text) / (n * (n - 1)) + 4 * (cubes - text * text) / n
        p_text = _normal_cdf((coincidence - text) / F.sqrt(var))
        return F.struct(f["encoding"].alias("encoding"), n.cast("long").alias("n"), p_text.alias("p_text"), F.when(p_text <= limit, _cauchy(p_chi, p_runs, p_serial)).alias("p_random"))

    return F.transform(F.array(facts), judge)[0]


def _bin(p: Column) -> Column:
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(10.0**-DECADES))) * BINS_A_DECADE), F.lit(DECADES * BINS_A_DECADE)).cast("int")


def _stratum(encoding: Column, n: Column) -> Column:
    octave = F.least(F.floor(F.log2(n.cast("double"))), F.lit(12)).cast("string")
    return F.concat_ws(":", encoding, octave, F.when(n < SHORT_CLASS, "short"))


def _with_candidates(docs: DataFrame, rate: float) -> DataFrame:
    """doc_id, base (spans) and candidates (start, end, encoding, n, p_random, p_text) of every row."""
    candidate = CANDIDATE % shortest(rate)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text, none = F.col("text"), F.array().cast(_SPAN)
    base = F.concat(
        F.when(text.rlike(ASSIGN_LONG), _spans(text, ASSIGN, 0, 2, 8)).otherwise(none),
        F.when(text.rlike(ACCESS), _spans(text, ACCESS, 1)).otherwise(none),
        F.when(text.rlike(HEX), _spans(text, HEX, 2)).otherwise(none),
    )
    docs = docs.withColumn("_runs", F.regexp_extract_all(text, F.lit(candidate), F.lit(0)))
    runs = F.col("_runs")
    found = F.when(F.size(runs) > 0, _spans(text, candidate, 3, matches=runs)).otherwise(none)
    tested = F.zip_with(found, runs, lambda s, r: F.struct(s["start"].alias("start"), s["end"].alias("end"), r.alias("run")))
    out = F.transform(tested, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _tests(x["run"], rate).alias("test")))
    return docs.select("doc_id", F.array_sort(base).alias("base"), out.alias("candidates"))


def discovery_bins(candidates: DataFrame, rate: float = DISCOVERY_RATE) -> dict[str, int]:
    """The lowest histogram bin of -log10 p that counts as a discovery, for each stratum that has one.

    `candidates` has stratum and bin; a bin stands for its largest p-value. At most 39 strata
    of 301 bins reach the driver's side of the plan, however many candidates there are.
    """
    counts = candidates.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("stratum").orderBy(F.col("bin").desc())
    listed = counts.withColumns({"rank": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy("stratum"))})
    p = F.pow(F.lit(10.0), -F.col("bin") / BINS_A_DECADE)
    found = listed.where(p * F.col("all") <= rate * F.col("rank")).groupBy("stratum").agg(F.min("bin").alias("bin"))
    return {r["stratum"]: r["bin"] for r in found.collect()}


def scan_secrets(docs: DataFrame, rate: float = DISCOVERY_RATE, least_random: float = LEAST_RANDOM) -> DataFrame:
    """doc_id and `spans` of every row: start, kind (index into KINDS) and end, in order.

    A null or empty text has no spans; ties at a start are ordered by kind; repeated rows get
    their spans each; an empty table has no candidates and no discoveries; other columns
    aren't read. A random span that a pattern's span covers is not repeated.
    """
    found = stored(_with_candidates(docs, rate), "secret-candidates")
    plausible = F.filter("candidates", lambda c: c["test"]["p_random"] >= least_random)
    listed = found.select(F.explode("candidates").alias("c")).select(_stratum(F.col("c.test.encoding"), F.col("c.test.n")).alias("stratum"), _bin(F.col("c.test.p_text")).alias("bin"))
    limits = discovery_bins(listed, rate)
    if not limits:
        return found.select("doc_id", F.col("base").alias("spans"))
    known = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])

    def discovered(c: Column) -> Column:
        limit = F.try_element_at(known, _stratum(c["test"]["encoding"], c["test"]["n"]))
        covered = F.exists("base", lambda b: (b["start"] <= c["start"]) & (b["end"] >= c["end"]))
        return F.coalesce(_bin(c["test"]["p_text"]) >= limit, F.lit(False)) & ~covered

    added = F.transform(F.filter(plausible, discovered), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return found.select("doc_id", F.array_sort(F.concat("base", added)).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _equals(value: int, x: Column) -> Column:
    return x == value


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, partial(_equals, k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
