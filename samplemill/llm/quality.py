"""Quality rules per document, and verdicts on whole hosts from shrunken failure rates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplemill.plans.session import cut

SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A host goes if the shrunken failure rate of its documents is above this.
MAX_HOST_RATE = 0.5
#: The prior weighs at least and at most as much as so many documents.
PRIOR_DOCS = (1.0, 1e6)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of eight words that occurs twice or more, the first time included.

    Windows get exact numbers by doubling: words, pairs, fours, eights. Once all are distinct, so are longer ones.
    """
    if len(words) <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    numbers = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    step, most = 1, len(seen)
    while True:
        pairs = numbers[:-step] * most + numbers[step:]
        step *= 2
        found, numbers, times = np.unique(pairs, return_inverse=True, return_counts=True)
        most = len(found)
        if most == len(pairs):
            return 0
        if step == WINDOW:
            break
    starts = np.flatnonzero(times[numbers] > 1)
    change = np.bincount(starts, minlength=len(words) + 1) - np.bincount(starts + WINDOW, minlength=len(words) + 1)
    return int((np.cumsum(change) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one text; zeros for NULL."""
    if not text:
        return (0,) * len(COUNTS)
    body = text.encode()
    words = body.split()
    blanks = len(body) - len(body.translate(None, SPACE))
    lines = [line for line in body.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - blanks,
        len(body) - len(body.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def with_counts(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    schema = docs.select(*keep).schema
    for name in COUNTS:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([counts(t.as_py()) for t in batch.column(len(keep))], np.int64).reshape(-1, len(COUNTS))
            columns = [pa.array(np.ascontiguousarray(c)) for c in rows.T]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=schema.names)

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def host_rates(marked: DataFrame, prior_docs: tuple[float, float] = PRIOR_DOCS) -> DataFrame:
    """``(host, rate)`` from rows ``(host, failed)``: failure rates, shrunken by an empirical beta prior.

    The prior has the mean and the variance of the plain rates of all hosts (method of moments). Two numbers
    are sent to the driver. Rows combine per host before the shuffle, so a host may hold any share of them.
    """
    hosts = marked.where("host IS NOT NULL").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("bad")
    )
    plain = F.col("bad") / F.col("n")
    mean, spread = hosts.agg(F.avg(plain), F.var_pop(plain)).first()
    least, most = prior_docs
    weight = most if not spread else min(most, max(least, mean * (1 - mean) / spread - 1))
    return hosts.select("host", ((F.col("bad") + F.lit(weight * (mean or 0.0))) / (F.col("n") + F.lit(weight))).alias("rate"))


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_host_rate: float = MAX_HOST_RATE,
) -> DataFrame:
    """``(id_col, counts, base_failed, kept, host_rate)``, one row per row of ``docs``.

    Every text is measured whole. A document fails by itself with under 20 words, or if over 30 % of its words lie
    in repeated eight-word windows. Failures are added up per host, the rates are shrunk towards the mean of all
    hosts, and the verdict goes back to the documents: a document that did not fail itself is dropped only if its
    host's shrunken rate is above ``max_host_rate``.

    A NULL text has no words. A NULL host is no host: it has no rate and no verdict. NULL ids and repeated rows stay
    as rows. Other columns are not read. An empty table gives no rows.
    """
    named = docs.select(F.col(id_col).alias("_id"), F.col(host_col).alias("host"), F.col(text_col).alias("_text"))
    measured = with_counts(named, "_text", ["_id", "host"])
    repeats = F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    table = cut(measured.withColumn("failed", (F.col("n_words") < MIN_WORDS) | repeats), "quality")
    out = table.join(host_rates(table), "host", "left")
    return out.select(
        F.col("_id").alias(id_col),
        *COUNTS,
        F.col("failed").alias("base_failed"),
        (~F.col("failed") & F.coalesce(F.col("rate") <= max_host_rate, F.lit(True))).alias("kept"),
        F.round("rate", 6).alias("host_rate"),
    )
