"""Quality rules whose cutoffs carry a guarantee: at most a stated share of good documents
is rejected, per stratum, at a stated confidence.

A rule rejects a document whose measure exceeds a cutoff. For each stratum and rule the
candidates are a fixed grid; labelled good documents are the holdout. A cutoff may be used
if the exact (Clopper-Pearson) upper bound of its false-rejection rate is within the
rule's share of the risk, at a confidence corrected for every candidate of every rule and
stratum that is tried (Bonferroni). Of these the one is taken that rejects most labelled
bad documents, each good one counting against it COST times; a rule that gains nothing
that way has no cutoff, so that good documents are not spent for nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, map_rows

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_exclaim long, n_letters long"

#: Rule name -> (measure per 1000, fixed candidate cutoffs per 1000, ascending).
GRID = [*range(10, 200, 10), *range(200, 1000, 25), *range(1000, 4001, 250)]


COST = 10


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of MEASURES over one whole text; null counts as empty."""
    if not text:
        return (0,) * 8
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() splits at the six ASCII white-space bytes and no others
    n = len(words)
    white = len(raw) - len(raw.translate(None, WHITE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen, dup_lines = set(), 0
    for line in raw.split(b"\n"):
        if line.strip(WHITE):
            if line in seen:
                dup_lines += 1
            else:
                seen.add(line)
    repeated, last = 0, -1
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            times = Counter(windows)
            for i, w in enumerate(windows):
                if times[w] > 1:
                    repeated += i + 2 - max(last, i - 1)
                    last = i + 2
    letters = sum(map(str.isalpha, text)) if not raw.isascii() else sum(map(len, raw.translate(None, _NOT_LETTERS).split()))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return n, len(text) - white, symbols, dup_lines, repeated, upper, text.count("!"), letters


_UPPER = bytes(range(65, 91))
_NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())


def measures(docs: DataFrame) -> DataFrame:
    """MEASURES of every whole text of ``docs(doc_id, text, stratum)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([measure(t) for t in batch["text"]], columns=[x.split()[0] for x in MEASURES.split(", ")], dtype="int64")
            yield pd.concat([batch[["doc_id", "stratum"]].reset_index(drop=True), found], axis=1)

    return map_rows(docs.select("doc_id", "text", "stratum"), run, f"doc_id long, stratum string, {MEASURES}")


def rules() -> dict[str, Column]:
    """Rule name -> measure per 1000; a document is rejected where it exceeds a cutoff."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.expr("1000 * n_symbols") / words,
        "exclaim": F.expr("1000 * n_exclaim") / words,
        "upper": F.expr("1000 * n_upper") / F.greatest(F.col("n_letters"), F.lit(1)),
        "dup_lines": F.expr("1000 * n_dup_lines") / words,
        "repeats": F.expr("1000 * n_repeat_words") / words,
        "long_words": F.expr("100 * word_chars") / words,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p)."""
    if k >= n:
        return 1.0
    if p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    const = math.lgamma(n + 1)
    first = max(0, min(k, int(n * p)) - 40 - int(40 * math.sqrt(n * p * (1 - p))))  # what lies below is under 1e-300 of the sum
    return min(1.0, math.fsum(math.exp(const - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(first, k + 1)))


def most_rejections(n: int, risk: float, miss: float) -> int:
    """Largest k whose exact upper confidence bound is within ``risk``, or -1: the bound
    for k of n is within ``risk`` exactly where P(X <= k | n, risk) <= miss."""
    low, high = -1, n
    while low < high - 1:
        mid = (low + high) // 2
        low, high = (mid, high) if binomial_tail_at_most(mid, n, risk) <= miss else (low, mid)
    return low


def select_cutoffs(found: DataFrame, labels: DataFrame, risk: float = 0.12, miss: float = 0.05) -> list[tuple[str, str, int]]:
    """(stratum, rule, cutoff per 1000) for each rule that may be used in a stratum.

    ``risk`` bounds the share of good documents that all rules together reject in a
    stratum, with probability 1 - ``miss`` over all strata at once. Holdout: the rows of
    ``labels(doc_id, quality)`` whose documents pass the base rules; quality 1 is good, 0
    is bad, and of several labels of a document the smallest counts. Counts come from one
    grouped pass; the driver gets a row for each (stratum, rule, passed cutoffs), whose
    number does not depend on the number of documents.
    """
    named = rules()
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    grid = F.array(*[F.lit(float(c)) for c in GRID])
    over = lambda value: F.size(F.filter(grid, lambda c: value > c))
    passed = F.array(*[F.struct(F.lit(name).alias("rule"), over(value).alias("over")) for name, value in named.items()])
    counts = (
        found.where(~base_failed()).join(known, "doc_id")
        .select("stratum", "good", F.explode(passed).alias("x"))
        .groupBy("stratum", "good", "x.rule", "x.over").count()
    ).collect()
    tables: dict[tuple[str, str], dict[bool, Counter]] = {}
    for row in counts:
        tables.setdefault((row["stratum"], row["rule"]), {True: Counter(), False: Counter()})[row["good"]][row["over"]] += row["count"]
    tests = max(1, len({s for s, _ in tables}) * len(named) * len(GRID))
    out = []
    for (stratum, rule), table in sorted(tables.items()):
        most, best = most_rejections(sum(table[True].values()), risk / len(named), miss / tests), (0, 0)
        for i, cutoff in enumerate(GRID):
            good, bad = (sum(n for over, n in table[k].items() if over > i) for k in (True, False))
            if good <= most:
                best = max(best, (bad - COST * good, cutoff))  # a tie goes to the looser cutoff
        if best[0] > 0:
            out.append((stratum, rule, best[1]))
    return out


def verdict(found: DataFrame, cutoffs: list[tuple[str, str, int]]) -> DataFrame:
    """Add base_failed and kept to measured rows."""
    spark = found.sparkSession
    rows = {}
    for stratum, rule, cutoff in cutoffs:
        rows.setdefault(stratum, {})[rule] = cutoff
    table = spark.createDataFrame([(s, r) for s, r in rows.items()], "stratum string, cutoffs map<string, int>")
    joined = found.join(F.broadcast(table), "stratum", "left")  # a row a stratum, at most as many as select_cutoffs collected
    over = F.lit(False)
    for name, value in rules().items():
        limit = F.try_element_at("cutoffs", F.lit(name))
        over = over | F.coalesce(value > limit, F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~over)


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.12, miss: float = 0.05) -> DataFrame:
    """Measures, base_failed and kept for every row of ``docs(doc_id, text, lang)``.

    The stratum is ``lang``; null is a stratum of its own. A null or empty text has no
    words and fails the base rule. Repeated rows are judged alike. With few labels in a
    stratum no cutoff can be proven, so only the base rules reject there. An empty table
    gives an empty result. Other columns are ignored.
    """
    found = cut(measures(docs.select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"))), "quality")
    return verdict(found, select_cutoffs(found, labels, risk, miss))


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``quality_rules`` rejects; columns as given."""
    judged = quality_rules(docs, labels)
    kept = judged.where("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
