"""Secret scans: fixed patterns, and random strings by character Markov models."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplemill.llm.workers import byte_slices, use_caches

# The kinds of base spans in the order in which they are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE, MIN_ACCESS = 6, 20

#: Runs that the models judge; shorter ones carry too little evidence.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WORD = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
#: What the models tell apart: letters without their case, digits, and marks between words as one.
ALPHABET = b"abcdefghijklmnopqrstuvwxyz0123456789+=-"
SIZE = len(ALPHABET)
CODE = np.full(256, -1, np.int16)
CODE[np.frombuffer(ALPHABET, np.uint8)] = np.arange(SIZE)
CODE[np.frombuffer(ALPHABET[:26].upper(), np.uint8)] = np.arange(26)
CODE[np.frombuffer(b"/_.", np.uint8)] = CODE[ord("-")]

#: Documents from which the models are learnt, on average: the bound of the sample.
SAMPLE = 20_000
#: A run is random if its log-likelihood ratio (nats) is this much in favour, in total and per character, and it has
#: so many different characters and digits (a ruler of dashes or an unusual name is as rare as a key, but no key).
MIN_RATIO, MIN_RATIO_EACH, MIN_DISTINCT, MIN_DIGITS = 15.0, 0.8, 8, 2


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` of the fixed patterns, in code points, by start and then by kind as listed."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def _pairs(run: str) -> np.ndarray:
    codes = CODE[np.frombuffer(run.encode(), np.uint8)]
    return codes[:-1].astype(np.int64) * SIZE + codes[1:]


def _examples(text: str) -> tuple[list[str], list[str]]:
    """Random strings (values of the fixed patterns) and ordinary words of a text."""
    spans = base_spans(text)
    values = []
    for a, kind, b in spans:
        part = text[a:b]
        values.append(ASSIGN.match(part)[1] if kind == "assign" else part)
    left, at = [], 0
    for a, _, b in spans:
        left.append(text[at : max(a, at)])
        at = max(at, b)
    left.append(text[at:])
    return values, [w for part in left for w in WORD.findall(part)]


def train(docs: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE) -> np.ndarray:
    """Log-likelihood ratios of character pairs, random over ordinary: ``SIZE x SIZE`` values.

    The labelled samples are what the fixed patterns find (random) and all other words (ordinary), in whole texts
    of about ``sample`` rows taken by a hash of the id. Pair counts are added up on the cluster; only the two
    fixed-size tables reach the driver. Half of the model of random strings is the uniform one, so that it does not
    only know the kinds of keys that the sample has.
    """
    share = min(1.0, sample / max(1, docs.count()))
    chosen = docs.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_caches("secrets")
        total = np.zeros((2, SIZE * SIZE), np.int64)
        for part in (p for batch in batches for p in byte_slices(batch, 0)):
            for text in part.column(0):
                for kind, strings in enumerate(_examples(text.as_py() or "")):
                    if strings:
                        # Joined by a character outside the alphabet, so that no pair spans two strings.
                        codes = CODE[np.frombuffer(" ".join(strings).encode(), np.uint8)].astype(np.int64)
                        inside = (codes[:-1] >= 0) & (codes[1:] >= 0)
                        total[kind] += np.bincount((codes[:-1] * SIZE + codes[1:])[inside], minlength=SIZE * SIZE)
        kind, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(cell), pa.array(total[kind, cell])], names=["kind", "cell", "n"])

    rows = chosen.select(text_col).mapInArrow(run, "kind long, cell long, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n")).collect()
    counted = np.zeros((2, SIZE * SIZE))
    for kind, cell, n in rows:
        counted[kind, cell] = n
    each = [_transitions(x, even) for x, even in zip(counted.reshape(2, SIZE, SIZE), (0.5, 0.001))]
    return (np.log(each[0]) - np.log(each[1])).ravel()


def _transitions(counts: np.ndarray, even: float) -> np.ndarray:
    """Probabilities of the next character; rare first characters fall back on how frequent the next is at all.

    The share ``even`` of all probability goes to all characters alike.
    """
    single = counts.sum(axis=0) / max(1.0, counts.sum()) if counts.any() else np.full(SIZE, 1.0 / SIZE)
    mixed = (counts + 5 * single) / (counts.sum(axis=1, keepdims=True) + 5)
    return (1 - even) * mixed + even / SIZE


def find_spans(text: str, ratios: np.ndarray) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans, and all spans: runs that overlap no base span and look random are added as ``markov``."""
    base = base_spans(text)
    covered: list[list[int]] = []
    for a, _, b in base:
        if covered and a < covered[-1][1]:
            covered[-1][1] = max(b, covered[-1][1])
        else:
            covered.append([a, b])
    more, i = [], 0
    for m in RUN.finditer(text):
        a, b = m.span()
        while i < len(covered) and covered[i][1] <= a:
            i += 1
        if i < len(covered) and covered[i][0] < b:
            continue
        ratio = float(ratios[_pairs(m[0])].sum())
        varied = len(set(m[0])) >= MIN_DISTINCT and sum(c.isdigit() for c in m[0]) >= MIN_DIGITS
        if varied and ratio >= max(MIN_RATIO, MIN_RATIO_EACH * (b - a)):
            more.append((a, "markov", b))
    order = (*KINDS, "markov")
    return base, sorted(base + more, key=lambda s: (s[0], order.index(s[1])))


def _written(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``(id_col, n_assign, n_access, n_hex, base_sha256, spans)``, one row per row of ``docs``.

    Spans are ``kind:start:end`` in code points, the end exclusive, by start and then by kind. Base spans come from
    fixed patterns. To these the models add ``markov`` spans: runs of 20 or more key characters that overlap no
    base span, have digits, and are far more likely under the model of random strings than under that of ordinary
    identifiers. The models do not see the case of letters.

    NULL is the empty text. Whole texts are scanned. NULL ids and repeated rows stay as rows, other columns are not
    read, and an empty table gives no rows.
    """
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    ratios = train(named, "_id", "_text", sample)
    schema = named.select("_id").schema
    for name in ("n_assign", "n_access", "n_hex"):
        schema = schema.add(name, "long")
    schema = schema.add("base_sha256", "string").add("spans", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, spans = find_spans(text.as_py() or "", ratios)
                kinds = [k for _, k, _ in base]
                digest = hashlib.sha256(_written(base).encode()).hexdigest()
                rows.append((*(kinds.count(k) for k in KINDS), digest, _written(spans)))
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=schema.names)

    return named.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", sample: int = SAMPLE) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mask``; overlapping spans are replaced as one.

    All rows and columns stay; texts without a span, and NULL, are unchanged. Repeated rows and NULLs in other columns
    stay as they are; an empty table gives no rows.
    """
    ratios = train(docs.select(id_col, text_col), id_col, text_col, sample)
    at = docs.columns.index(text_col)

    def cleaned(text: str | None) -> str | None:
        spans = find_spans(text, ratios)[1] if text else []
        if not spans:
            return text
        out, end = [], 0
        for a, _, b in spans:
            if a >= end:
                out += [text[end:a], mask]
            end = max(end, b)
        return "".join([*out, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_caches("secrets")
        for batch in batches:
            for part in byte_slices(batch, at):
                texts = pa.array([cleaned(t.as_py()) for t in part.column(at)], batch.schema.field(at).type)
                yield part.set_column(at, batch.schema.field(at), texts)

    return docs.mapInArrow(run, docs.schema)
