"""Near-duplicate groups by SimHash, with bit-sliced comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplemill.llm.graph import components, roots
from samplemill.plans.session import cut

BITS = 64
SEED = 42
#: A bucket with more fingerprints is divided by further bits; it bounds what one task compares at once.
BUCKET = 4096
#: Word pairs of the sliced store that are compared at once.
SLICE = 1 << 17
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``words`` words, repeats included; a shorter text is one run, no word none.

    Words are maximal runs without ASCII white space, with A-Z in lower case.
    """
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    runs = map(b" ".join, zip(*(w[i:] for i in range(words))))
    return np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in runs), np.uint64, len(w) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, BITS // 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text_col: str, words: int, keep: list[str]) -> DataFrame:
    """``(*keep, fp)``: the fingerprint of every text as a long integer."""
    schema = docs.select(*keep).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep))
            fps = [fingerprint(shingle_hashes(t.as_py(), words)) for t in texts]
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], fp], names=[*keep, "fp"])

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def _bands(bits: list[int], radius: int) -> list[tuple[int, ...]]:
    """Choices of bits of which at least one is equal in any two values with up to ``radius`` differing bits.

    The bits are cut into ``radius + 2`` bands, of which two at least have no differing bit.
    """
    n = radius + 2
    bands = [bits[i * len(bits) // n : (i + 1) * len(bits) // n] for i in range(n)]
    return [tuple(a + b) for a, b in combinations(bands, 2)]


def _masked(fp: Column, bits: tuple[int, ...]) -> Column:
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask))


def _buckets(fps: DataFrame, radius: int, limit: int) -> DataFrame:
    """Arrays of fingerprints: any two within ``radius`` are together in one of them at least.

    A bucket holds the values that agree in half of the bits (radius 2). A bucket of over ``limit`` values is
    divided again by half of its remaining bits, so it holds at most ``2 ** 16`` distinct values by construction.
    """
    first = _bands(list(range(BITS)), radius)
    rest = [_bands([b for b in range(BITS) if b not in bits], radius) for bits in first]
    fp = F.col("fp")
    keyed = fps.select("fp", F.posexplode(F.array(*[_masked(fp, b) for b in first])).alias("k", "key"))
    sizes = keyed.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n"))
    # The sizes of single values need not travel any further.
    sizes = cut(sizes.where("n > 1"), "bucket-sizes")
    shared = keyed.join(sizes, ["k", "key"])
    finer = F.array(*[F.array(*[_masked(fp, b) for b in choice]) for choice in rest])
    small = shared.where(F.col("n") <= limit).select("fp", "k", "key", F.lit(-1).alias("k2"), F.lit(0).cast("long").alias("key2"))
    large = shared.where(F.col("n") > limit).select("fp", "k", "key", F.posexplode(finer[F.col("k")]).alias("k2", "key2"))
    parts = small.unionByName(large).groupBy("k", "key", "k2", "key2").agg(F.collect_list("fp").alias("fps"))
    return parts.where(F.size("fps") > 1).select("fps")


def sliced_pairs(values: np.ndarray, starts: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs within ``radius`` differing bits, of values of the same bucket.

    ``values`` has a row of one or more 64-bit words per value, ``starts`` the first position of each bucket and the
    end of the last. Bit planes are stored vertically: 64 values of a bucket share one word of each plane. A value
    meets such a word at a time; the planes are added up by carry-save counters that start so high that a carry
    out of the top plane says "beyond the radius". Words in which every value is beyond it are abandoned.
    """
    values = values.reshape(len(values), -1)
    n = np.diff(starts)
    words = -(-n // 64)
    base = np.concatenate([[0], np.cumsum(words)])
    bucket = np.repeat(np.arange(len(n)), n)
    place = base[bucket] * 64 + np.arange(len(values)) - starts[bucket]
    store, there = np.zeros((base[-1] * 64, values.shape[1]), np.uint64), np.zeros(base[-1] * 64, np.uint8)
    store[place], there[place] = values, 1
    at = np.zeros(base[-1] * 64, np.int64)
    at[place] = np.arange(len(values))
    valid = np.packbits(there, bitorder="little").view(np.uint64)

    def plane(p: int) -> np.ndarray:
        bits = (store[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1)
        return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)

    planes = [plane(p) for p in range(64 * values.shape[1])]
    own = place // 64
    each = base[bucket + 1] - own  # words that a value meets: its own and the later ones
    ends = np.cumsum(each)
    width = max(1, (radius + 1).bit_length())
    begin = (1 << width) - 1 - radius
    lo = 0
    while lo < len(values):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
        q = np.repeat(np.arange(lo, hi), each[lo:hi])
        w = own[q] + np.arange(len(q)) - np.repeat(np.cumsum(each[lo:hi]) - each[lo:hi], each[lo:hi])
        lo = hi
        counters = [np.full(len(q), FULL if begin >> j & 1 else 0, np.uint64) for j in range(width)]
        # Places without a value are beyond the radius from the start, so that they hold nothing up.
        over = ~valid[w]
        for p in range(len(planes)):
            if p % 64 == 0:
                mine = values[q, p // 64]
            carry = planes[p][w] ^ (np.uint64(0) - ((mine >> np.uint64(p % 64)) & np.uint64(1)))
            for j in range(width):
                counters[j], carry = counters[j] ^ carry, counters[j] & carry
            over |= carry
            if p % 8 == 7:
                alive = over != FULL
                if 4 * alive.sum() < 3 * len(q):
                    q, w, mine, over = q[alive], w[alive], mine[alive], over[alive]
                    counters = [c[alive] for c in counters]
        hits = ~over
        bit = (place[q] % 64).astype(np.uint64)
        later = FULL << bit & ~(np.uint64(1) << bit)
        hits = np.where(w == own[q], hits & later, hits)
        some = np.flatnonzero(hits)
        bits = np.unpackbits(hits[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, column = np.nonzero(bits)
        yield q[some][row], at[w[some][row] * 64 + column]


def _links(buckets: DataFrame, radius: int) -> DataFrame:
    """Links that connect, in each bucket, exactly what its pairs within the radius connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                column = whole.slice(i, 512).column(0)
                values = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                starts = column.offsets.to_numpy() - column.offsets[0].as_py()
                root = np.arange(len(values))
                for a, b in sliced_pairs(values, starts, radius):
                    # What is known goes in as links too, so the pairs of a dense bucket are never kept.
                    known = np.flatnonzero(root != np.arange(len(root)))
                    root = roots(len(values), np.concatenate([known, a]), np.concatenate([root[known], b]))
                linked = np.flatnonzero(root != np.arange(len(root)))
                ends = [pa.array(values[x].view(np.int64)) for x in (linked, root[linked])]
                yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    return buckets.mapInArrow(run, "a long, b long")


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    radius: int = 2,
    bucket: int = BUCKET,
) -> DataFrame:
    """``(id_col, fingerprint, component_id)``, one row per row of ``docs``.

    Two texts are linked if their 64-bit SimHash over word shingles differs in at most ``radius`` (0 to 2) bits;
    ``component_id`` is the smallest id that links reach, the row's own included. Equal fingerprints are one
    node, so large groups of copies are a single row from the first aggregate on.

    NULL, empty and blank texts have fingerprint zero and are linked like any other. A row with a NULL id is
    kept; it belongs to a component but cannot name it (``component_id`` is NULL if no member has an id).
    Repeated rows are repeated in the result. Other columns are not read. An empty table gives no rows.
    """
    if not 0 <= radius <= 2:
        raise ValueError("the radius is 0, 1 or 2")
    table = cut(with_fingerprints(docs.withColumn("_id", F.col(id_col)), text_col, words, ["_id"]), "fingerprints")
    nodes = table.groupBy("fp").agg(F.min("_id").alias("least"))
    found = components(_links(_buckets(nodes.select("fp"), radius, bucket), radius))
    named = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # Only fingerprints that are linked to others need the name of their component.
    of_fp = named.join(names, "root").select("fp", "component_id")
    out = table.join(of_fp, "fp")
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
