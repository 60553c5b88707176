"""Packing documents into sequences at target proportions of their sources."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samplemill.llm.merges import MergeTable
from samplemill.llm.workers import byte_slices, on_change, use_caches
from samplemill.plans.session import cut

LENGTH = 2048
#: Sequences per window of the round-robin: within a window, the sources have their target proportions.
WINDOW = 64
END = 1
#: Windows whose totals are added up together, so that no task sees all of them.
GROUP = 4096
#: Bytes of the caches of encoded words in a Python worker, and what an entry takes besides the word and its ids.
CACHE, ENTRY = 120 << 20, 140


#: A word of Latin letters that neither normalisation nor splitting changes but for its case, and marks after it.
PLAIN = re.compile("^([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,]*)$", re.MULTILINE)


class WordEncoder:
    """Ids of whole texts by a tokenizer that lower-cases, drops white space and merges pairs within words.

    No token of such a tokenizer reaches across a blank or a line feed, so the words between them are encoded once
    and kept. New plain words are merged all at once with the tokenizer's own pairs; all others go through the
    library. Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit into 16 bits")
        model = json.loads(self.tokenizer.to_str())["model"]
        vocab, final = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.table = MergeTable({(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in reversed([*enumerate(pairs)])})
        # Bytes are written as visible characters: printable ones as themselves, the others from U+0100 on.
        shown = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        shown |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.inside = np.array([vocab[shown[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[shown[b] + final] for b in range(256)], np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {"": b""}
        self.stems: dict[str, bytes] = {}
        self.held = 0

    def _library(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        plain = PLAIN.findall("\n".join(words))
        names = list(map("".join, plain))
        other = {tail for _, tail in plain}.difference(self.known).union(set(words).difference(names))
        self.known.update(zip(other, self._library(list(other))))
        # The case of these letters changes one by one, so that all words may be joined for it.
        lower = "\n".join([stem for stem, _ in plain]).lower().split("\n") if plain else []
        stems = list(set(lower).difference(self.stems))
        self.held += ENTRY * (len(words) + len(stems)) + 2 * sum(map(len, words)) + 2 * sum(map(len, stems))
        spelt = [w.encode() for w in stems]
        codes = np.frombuffer(b"".join(spelt), np.uint8)
        sizes = np.array([len(w) for w in spelt], np.int64)
        symbols = self.inside[codes]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.final[codes[ends]]
        ids, sizes = self.table.run(symbols, sizes)
        body, ends = ids.astype("<u2").tobytes(), 2 * np.cumsum(sizes)
        self.stems.update(zip(stems, [body[a:b] for a, b in zip((ends - 2 * sizes).tolist(), ends.tolist())]))
        of_stem, of_tail = self.stems, self.known
        ids_of = [of_stem[stem] + of_tail[tail] if tail else of_stem[stem] for stem, (_, tail) in zip(lower, plain)]
        self.known.update(zip(names, ids_of))

    def encode(self, texts: list[str], cache: int = CACHE) -> list[bytes]:
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        if self.held > cache:
            self.forget()
        new = list(set().union(*parts).difference(self.known))
        for i in range(0, len(new), 20_000):
            self._learn(new[i : i + 20_000])
        ids_of = self.known.__getitem__
        return [b"".join(map(ids_of, words)) for words in parts]


_ENCODERS: dict[str, WordEncoder] = {}


def _forget() -> None:
    for encoder in _ENCODERS.values():
        encoder.forget()


on_change("packing", _forget)


def _encoder(path: str) -> WordEncoder:
    """One per Python worker and file."""
    use_caches("packing")
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def with_ids(docs: DataFrame, text_col: str, keep: list[str], path: str, end: int, cache: int = CACHE) -> DataFrame:
    """``(*keep, n, ids)``: the ids of every text and the end id, as little-endian 16-bit integers."""
    schema = docs.select(*keep).schema.add("n", "long").add("ids", "binary")
    last = np.array([end], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for part in byte_slices(batch, len(keep), 1 << 20):
                ids = [x + last for x in encoder.encode([t.as_py() or "" for t in part.column(len(keep))], cache)]
                n = pa.array([len(x) // 2 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], n, pa.array(ids, pa.binary())], names=schema.names)

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def _earlier(table: DataFrame, by: list[str], order: list[str], value: str) -> Column:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0).cast("long"))


def place(rows: DataFrame, targets: Mapping[str, float] | None, window_tokens: int) -> DataFrame:
    """``(row, at)``: where each row ``(row, source, n)`` starts in the packed stream.

    A source is a queue in row order. Per round every queue earns its share of a window and hands out documents
    while it has credit; the last one may overdraw it, and the debt counts against the next rounds. A document
    therefore leaves in the round in which the tokens that its queue has earned reach the document's start, so
    rounds need no loop: running totals per queue (by partition first, then within it) give that start, carried
    across windows and partitions. Queues that run dry leave their part to the others.
    """
    same = F.col("source").eqNullSafe(F.col("s2"))
    rows = rows.withColumn("part", F.shiftrightunsigned("row", 33))
    parts = rows.groupBy("source", "part").agg(F.sum("n").alias("tokens"))
    parts = parts.withColumn("before", _earlier(parts, ["source"], ["part"], "tokens"))
    totals = cut(rows.groupBy("source").agg(F.sum("n").alias("total")), "totals")
    grand = totals.agg(F.sum("total")).first()[0] or 0

    # How many tokens a queue hands out per unit of the clock, and what all have handed out by a time on it.
    named = {} if targets is None else {s: t for s, t in targets.items() if t > 0}
    if sum(named.values()) >= 1 or any(t < 0 for t in (targets or {}).values()):
        raise ValueError("targets are shares whose sum is below 1; the other sources share the rest")
    mine = F.col("total") / F.lit(float(max(1, grand)))
    if named:
        held = {s: n for s, n in totals.where(F.col("source").isin(list(named))).collect()}
        others = grand - sum(held.values())
        rest = 1 - sum(named.values())
        speeds = [(named[s], held.get(s, 0)) for s in named] + [(rest, others)]
        speed = F.lit(rest) * F.col("total") / F.lit(float(max(1, others)))
        for s, t in named.items():
            speed = F.when(F.col("source") == s, F.lit(t)).otherwise(speed)
        mine = speed
    else:
        speeds = [(1.0, grand)]
    totals = totals.select(F.col("source").alias("s2"), mine.alias("speed"))
    parts = parts.join(totals, same, "left").select(F.col("source").alias("s2"), F.col("part").alias("p2"), "before", "speed")

    inner = rows.withColumn("inner", _earlier(rows, ["source", "part"], ["row"], "n"))
    timed = inner.join(parts, same & (F.col("part") == F.col("p2"))).withColumn("clock", (F.col("before") + F.col("inner")) / F.col("speed"))
    handed = reduce(lambda a, b: a + b, [F.least(F.lit(s) * F.col("clock"), F.lit(float(t))) for s, t in speeds])
    timed = timed.select("row", "source", "n", "clock", F.floor(handed / window_tokens).alias("w"))

    windows = timed.groupBy("w").agg(F.sum("n").alias("tokens")).withColumn("g", F.floor(F.col("w") / GROUP))
    groups = windows.groupBy("g").agg(F.sum("tokens").alias("tokens"))
    groups = groups.select("g", _earlier(groups, [], ["g"], "tokens").alias("base"))
    windows = windows.withColumn("inner", _earlier(windows, ["g"], ["w"], "tokens")).join(groups, "g")
    windows = windows.select("w", (F.col("base") + F.col("inner")).alias("base"))
    timed = timed.withColumn("inner", _earlier(timed, ["w"], ["clock", "source", "row"], "n")).join(windows, "w")
    return timed.select("row", (F.col("base") + F.col("inner")).alias("at"))


def _pieces(placed: DataFrame, length: int, id_type) -> DataFrame:
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("_id", id_type)])
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    for name in names:
        schema = schema.add(name, "long")
    schema = schema.add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 2, 1 << 20):
                rows, source, bodies = [], [], []
                for k, (n, ids, at) in enumerate(zip(*(part.column(j).to_pylist() for j in (1, 2, 3)))):
                    wide = np.frombuffer(ids, "<u2").astype("<u4")
                    start = 0
                    while start < n:
                        size = min(n - start, length - (at + start) % length)
                        body = wide[start : start + size].tobytes()
                        rows.append((start, size, zlib.crc32(body), n, (at + start) // length, (at + start) % length))
                        source.append(k)
                        bodies.append(body)
                        start += size
                columns = np.array(rows, np.int64).reshape(-1, len(names)).T
                arrays = [part.column(0).take(pa.array(source, pa.int64()))]
                arrays += [pa.array(np.ascontiguousarray(c)) for c in columns]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(bodies, pa.binary())], names=["_id", *names, "ids"])

    return placed.select("_id", "n", "ids", "at").mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    targets: Mapping[str, float] | None = None,
    length: int = LENGTH,
    window: int = WINDOW,
    tokenizer: str | None = None,
    end: int = END,
    cache: int = CACHE,
) -> DataFrame:
    """``(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids)``: one row per piece of a document.

    A document is its ids and the id ``end``. Its pieces are consecutive, and each fills a stretch of one sequence of
    ``length`` ids; every sequence but the last of the corpus is full. ``ids`` are little-endian 32-bit integers.
    Within each window of ``window`` sequences the sources have their target proportions, up to one document of debt
    per source: ``targets`` are shares of the named sources, and the others share the rest by their size. Without
    targets every source has its share of all tokens, so that all end together. What remains when a source has run
    dry is filled by the others at their ratio.

    A NULL text is empty: one piece with the end id. NULL sources are one queue. NULL ids and repeated rows are
    packed like all others. Other columns are not read. An empty table gives no rows. ``cache`` are the bytes of
    encoded words that a Python worker keeps.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    named = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), F.col(text_col).alias("_text"))
    # Rows are numbered as they are written: partition and place within it.
    encoded = with_ids(named, "_text", ["_id", "source"], path, end, cache)
    table = cut(encoded.withColumn("row", F.monotonically_increasing_id()), "ids")
    placed = place(table.select("row", "source", "n"), targets, window * length)
    pieces = _pieces(table.join(placed, "row"), length, named.schema["_id"].dataType)
    return pieces.withColumnRenamed("_id", id_col)
