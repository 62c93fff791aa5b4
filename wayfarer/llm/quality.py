"""Quality rules for documents, and what they say about hosts.

Base rules judge a document by its own text. Soft rules give a severity: how many times over its limit
the worst of symbols, repeated lines and mean word length is. A document fails if a base rule
fails or its severity is over 1. Failures are added up by host. A host's rate has a beta prior, fitted to all
hosts by moments; its posterior tells the host's verdict:

* strict, if the rate is over RATIO times the corpus rate, with a chance that CERTAIN standard deviations stand for;
* trusted, if it is as surely under the corpus rate over RATIO;
* normal otherwise.

The verdict goes back to the documents as the severity that they may have (ALLOWED). So clean
documents stay whatever their host, and what base rules reject goes whatever its host.

Null texts have no words and fail. Null hosts form a host of their own. Null and repeated doc_ids
are rows like others. Columns other than doc_id, text and the host are not touched. An empty table gives no row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, arrow_limits, batches_of, release, unused, with_group_figures, written

SYMBOLS = "#*$%&|<>"
#: Severity that a host's verdict allows its documents.
ALLOWED = {"trusted": math.inf, "normal": 3.0, "strict": 1.0}
RATIO, CERTAIN = 1.5, 2.0
#: Soft limits: symbols a word, share of repeated lines, least and greatest mean word in code points.
SYMBOL_SHARE, DUP_SHARE, WORD_MEANS = 0.1, 0.3, (2, 15)
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: White space of str.split() that doesn't part words here.
_OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words_of(text: str) -> list[str]:
    """Words, cut at space and U+0009 to U+000D only."""
    return WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def figures_of(text: str | None) -> tuple[int, ...]:
    """FIGURES of a whole text."""
    if not text:
        return (0,) * len(FIGURES)
    words = words_of(text)
    n = len(words)
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line in seen:
            lines += 1
            dup += 1
        elif line.strip(" \t\n\v\f\r"):
            lines += 1
            seen.add(line)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            found, reach = Counter(windows), 0
            for i, w in enumerate(windows):
                if found[w] > 1:
                    repeated += i + 3 - max(i, reach)
                    reach = i + 3
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeated, lines


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and FIGURES of every document."""
    arrow_limits(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), *[(f, pa.int64()) for f in FIGURES]])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        release()
        for batch in batches:
            for doc_id, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                yield doc_id, name, *figures_of(text.as_py())

    slim = docs.select(F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(lambda b: batches_of(rows(b), schema), "doc_id long, host string, " + ", ".join(f"{f} long" for f in FIGURES))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def severity_of(n: int, chars: int, symbols: int, dup: int, repeated: int, lines: int) -> float:
    """The worst soft rule, as a multiple of its limit; 0 without words. A mean word beyond its limits counts as twice the limit."""
    if not n:
        return 0.0
    odd = 2.0 * (chars < WORD_MEANS[0] * n or chars > WORD_MEANS[1] * n)
    return max(symbols / n / SYMBOL_SHARE, dup / lines / DUP_SHARE, odd)


def severity() -> Column:
    """severity_of() as a column over FIGURES."""
    n, chars = F.col("n_words"), F.col("word_chars")
    odd = F.when((chars < WORD_MEANS[0] * n) | (chars > WORD_MEANS[1] * n), 2.0).otherwise(0.0)
    return F.when(n > 0, F.greatest(F.col("n_symbols") / n / SYMBOL_SHARE, F.col("n_dup_lines") / F.col("n_lines") / DUP_SHARE, odd)).otherwise(0.0)


def failed() -> Column:
    return base_failed() | (severity() > 1)


def prior(hosts: DataFrame) -> tuple[float, float]:
    """Beta prior (alpha, beta) of the failure rate by the method of moments over hosts (failed, docs)."""
    rate = F.col("failed") / F.col("docs")
    f = hosts.agg(F.count("*").alias("k"), F.sum("docs").alias("n"), F.sum("failed").alias("f"), F.sum(rate).alias("r"), F.sum(rate * rate).alias("rr"), F.sum(1 / F.col("docs")).alias("inv")).first()
    if not f.k:
        return 1.0, 1.0
    mean = min(max(f.f / f.n, 1e-6), 1 - 1e-6)
    spread = f.rr / f.k - 2 * mean * f.r / f.k + mean * mean
    between = spread - mean * (1 - mean) * f.inv / f.k  # less what chance alone makes
    strength = mean * (1 - mean) / between - 1 if between > 1e-9 else 1e4
    strength = min(max(strength, 1.0), 1e4)
    return mean * strength, (1 - mean) * strength


def host_rate(n_failed: Column, n_docs: Column, alpha: float, beta: float) -> Column:
    """Posterior mean of a host's failure rate."""
    return (n_failed + alpha) / (n_docs + alpha + beta)


def host_verdict(rate: Column, n_docs: Column, alpha: float, beta: float) -> Column:
    """strict, trusted or normal, from the posterior's mean and standard deviation."""
    corpus = alpha / (alpha + beta)
    reach = CERTAIN * F.sqrt(rate * (1 - rate) / (n_docs + alpha + beta + 1))
    return F.when(rate - reach > RATIO * corpus, "strict").when(rate + reach < corpus / RATIO, "trusted").otherwise("normal")


def allowed(verdict: Column) -> Column:
    return F.when(verdict == "strict", ALLOWED["strict"]).when(verdict == "trusted", ALLOWED["trusted"]).otherwise(ALLOWED["normal"])


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """Per document: doc_id, host, FIGURES, base_failed, severity, host_rate, host_verdict, kept."""
    figures = written(measure(docs, host).withColumns({"base_failed": base_failed(), "severity": severity(), "failed": failed().cast("long")}), "quality")
    hosts = figures.groupBy("host").agg(F.sum("failed").alias("failed"), F.count("*").alias("docs"))
    alpha, beta = prior(hosts)
    row = F.concat_ws(" ", F.col("doc_id").cast("string"), F.col("n_words").cast("string"), F.col("word_chars").cast("string"))
    out = with_group_figures(figures, "host", row, {"host_failed": (F.col("failed"), "sum"), "host_docs": (F.lit(1).cast("long"), "sum")})
    out = out.withColumn("host_rate", host_rate(F.col("host_failed"), F.col("host_docs"), alpha, beta))
    out = out.withColumn("host_verdict", host_verdict(F.col("host_rate"), F.col("host_docs"), alpha, beta))
    kept = ~F.col("base_failed") & (F.col("severity") <= allowed(F.col("host_verdict")))
    return out.select("doc_id", "host", *FIGURES, "base_failed", "severity", "host_rate", "host_verdict", kept.alias("kept"))


#: Hosts of another verdict than normal that are broadcast; beyond, they meet the documents in a salted join.
BROADCAST_HOSTS = 100_000
SALTS = 64


def keep(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns.

    Hosts are judged first, from figures written in the shared folder. Then every row is judged where
    it lies, by its own text and what its host's verdict allows, so neither texts nor repeated doc_ids
    have to meet in a join.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    figures = written(measure(docs, host).select("host", failed().cast("long").alias("failed")), "quality")
    hosts = written(figures.groupBy("host").agg(F.sum("failed").alias("failed"), F.count("*").alias("docs")), "hosts")
    alpha, beta = prior(hosts)
    its_host, its_limit, salt, part = (unused(n, docs.columns) for n in ("host", "limit", "salt", "part"))
    verdict = host_verdict(host_rate(F.col("failed"), F.col("docs"), alpha, beta), F.col("docs"), alpha, beta)
    others = hosts.select(F.col("host").alias(its_host), verdict.alias("verdict")).filter("verdict <> 'normal'").select(its_host, allowed(F.col("verdict")).alias(its_limit))
    name = F.col(host).cast("string")
    if others.count() <= BROADCAST_HOSTS:
        marked = docs.join(F.broadcast(others), name.eqNullSafe(F.col(its_host)), "left")
    else:
        others = others.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = docs.withColumn(salt, F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")).join(others, name.eqNullSafe(F.col(its_host)) & (F.col(salt) == F.col(part)), "left")
    marked = marked.select(*docs.columns, F.coalesce(its_limit, F.lit(ALLOWED["normal"])).alias(its_limit))
    at = docs.columns.index("text")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            good = [passes(text.as_py(), limit) for text, limit in zip(batch.column(at), batch.column(batch.num_columns - 1).to_pylist())]
            yield batch.select(list(range(batch.num_columns - 1))).filter(pa.array(good, pa.bool_()))

    return marked.mapInArrow(choose, docs.schema)


def passes(text: str | None, limit: float) -> bool:
    """Whether one text passes the base rules, with a severity of at most limit."""
    n, *others = figures_of(text)
    return n >= 50 and 100 * others[3] <= 50 * n and severity_of(n, *others) <= limit
