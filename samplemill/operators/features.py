"""Numeric features per sample, from content and from section or import tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samplemill.functions.ids import as_column, bound
from samplemill.functions.lists import character_bytes, list_sizes, lists_of
from samplemill.plans.staged import exploded

# Window and step of the entropy histogram, and the printable range of strings.
WINDOW, STEP = 2048, 1024
PRINTABLE = r"[\x20-\x7f]{5,}"
PATTERNS = {"paths": r"(?i)c:\\", "urls": r"(?i)https?://", "registry": "HKEY_", "mz": "MZ"}
DIRECTORIES = 15
BLOCK_BYTES = 1 << 20


@F.arrow_udf(T.ArrayType(T.LongType()))
def byte_histogram(contents: pa.Array) -> pa.Array:
    """Count of each of the 256 byte values."""
    return _counted(contents, 256, lambda b: np.bincount(b, minlength=256))


def _counted(contents: pa.Array, width: int, count: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """``count`` of every content as one flat list array; NULL stays NULL. No content is copied."""
    out = np.zeros((len(contents), width), np.int64)
    for row, content in zip(out, contents):
        if content.is_valid:
            row[:] = count(np.frombuffer(content.as_buffer(), np.uint8))
    return lists_of(out.reshape(-1), np.full(len(contents), width), contents)


def shares(histogram: Column | str) -> Column:
    """Histogram divided by its sum; all zero for an empty one."""
    h = as_column(histogram)
    total = F.aggregate(h, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return bound(total, lambda n: F.transform(h, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))


@F.arrow_udf(T.ArrayType(T.LongType()))
def byte_entropy_histogram(contents: pa.Array) -> pa.Array:
    """16 x 16 counts of (entropy of the window, high nibble) over sliding windows.

    Content shorter than a window is one block; probabilities are still relative to the window.
    """
    return _counted(contents, 256, _entropy_counts)


def _entropy_counts(values: np.ndarray) -> np.ndarray:
    """Nibbles are counted once, per step; a window is the difference of two running counts."""
    if len(values) < WINDOW:
        counts = np.bincount(values >> 4, minlength=16)[None, :]
    else:
        steps, width = (len(values) - WINDOW) // STEP + WINDOW // STEP, WINDOW // STEP
        running = np.zeros((steps + 1, 16), np.int64)
        for low in range(0, steps, BLOCK_BYTES // STEP):
            high = min(steps, low + BLOCK_BYTES // STEP)
            cells = values[low * STEP : high * STEP].reshape(-1, STEP) >> 4
            cells = cells + (16 * np.arange(high - low, dtype=np.int32))[:, None]
            running[low + 1 : high + 1] = np.bincount(cells.ravel(), minlength=16 * (high - low)).reshape(-1, 16)
        np.cumsum(running, axis=0, out=running)
        counts = running[width:] - running[:-width]
    p = counts.astype(np.float32) / WINDOW
    bits = -np.where(counts > 0, p * np.log2(np.where(counts > 0, p, 1)), 0).sum(axis=1) * 2
    out = np.zeros((16, 16), np.int64)
    np.add.at(out, np.minimum((bits * 2).astype(int), 15), counts)
    return out.reshape(-1)


def string_runs(content: Column | str) -> Column:
    """Runs of at least five printable characters."""
    return F.regexp_extract_all(F.decode(as_column(content), "ISO-8859-1"), F.lit(PRINTABLE), F.lit(0))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _printable_histogram(runs: pa.Array) -> pa.Array:
    """Counts of the characters of all runs of a row, which lie next to each other in the array's buffer."""
    out = np.zeros((len(runs), 96), np.int64)
    for row, texts in zip(out, runs):
        if texts.is_valid and len(texts.values):
            row[:] = np.bincount(character_bytes(texts.values) - 0x20, minlength=96)
    return lists_of(out.reshape(-1), np.full(len(runs), 96), runs)


def string_features(df: DataFrame, content: str) -> DataFrame:
    """Number and mean length of printable runs, their 96-bin distribution, entropy and total, pattern counts."""
    runs = F.col("_runs")
    latin = F.decode(F.col(content), "ISO-8859-1")
    total = F.aggregate(runs, F.lit(0).cast("bigint"), lambda acc, r: acc + F.length(r))
    out = df.withColumn("_runs", string_runs(content)).withColumn("_hist", _printable_histogram(runs))
    p = shares("_hist")
    entropy = F.aggregate(
        p, F.lit(0.0), lambda acc, x: acc - F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))
    )
    numbers = F.size(runs)
    out = out.withColumn("numstrings", numbers.cast("bigint"))
    out = out.withColumn("printables", total)
    out = out.withColumn("avlength", F.when(numbers > 0, total / numbers).otherwise(F.lit(0.0)))
    out = out.withColumn("printabledist", p).withColumn("entropy", entropy)
    for name, pattern in PATTERNS.items():
        out = out.withColumn(name, F.regexp_count(latin, F.lit(pattern)).cast("bigint"))
    return out.drop("_runs", "_hist")


def hash_bucket(digest: Column | str, width: int) -> Column:
    """Bucket of a token, from the first eight hex digits of its md5."""
    return F.pmod(F.conv(F.substring(as_column(digest), 1, 8), 16, 10).cast("bigint"), F.lit(width)).cast("int")


def hash_sign(digest: Column | str) -> Column:
    """+1 or -1, from the ninth hex digit of a token's md5."""
    return F.when(F.substring(as_column(digest), 9, 1) < "8", F.lit(1)).otherwise(F.lit(-1))


def hashed(df: DataFrame, id_col: str, tokens: Column | str, width: int, value: Column | None = None) -> DataFrame:
    """Hashing trick as a sparse table ``(id, bucket, value)``.

    ``tokens`` is an array of strings, or with ``value`` a plain column of a long table with
    one (token, value) per row.
    """
    if value is None:
        long = exploded(df, tokens, "_t", [id_col]).withColumn("_v", F.lit(1.0))
    else:
        long = df.select(id_col, as_column(tokens).alias("_t"), value.cast("double").alias("_v"))
    # A column of its own: the digest is needed twice and taken once.
    long = long.select(id_col, F.md5("_t").alias("_m"), "_v")
    return (
        long.groupBy(id_col, hash_bucket("_m", width).alias("bucket"))
        .agg(F.sum(hash_sign("_m") * F.col("_v")).alias("value"))
        .where("value <> 0")
    )


def dense(sparse: DataFrame, id_col: str, width: int, name: str = "vector") -> DataFrame:
    """Sparse table to one array per id. The map of an id is bound, or the optimizer builds it anew for every place."""
    entries = F.map_from_entries(F.collect_list(F.struct("bucket", "value")))
    places = F.sequence(F.lit(0), F.lit(width - 1))
    filled = lambda m: F.transform(places, lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)))
    return sparse.groupBy(id_col).agg(entries.alias("_m")).select(id_col, bound(F.col("_m"), filled).alias(name))


def section_counts(sections: DataFrame, id_col: str) -> DataFrame:
    """Sections, empty ones, unnamed ones, readable and executable ones, writable ones (columns ``size, name, props``)."""
    has = lambda p: F.array_contains("props", p)
    return sections.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n_sections"),
        F.count_if(F.col("size") == 0).alias("n_zero"),
        F.count_if(F.col("name") == "").alias("n_unnamed"),
        F.count_if(has("MEM_READ") & has("MEM_EXECUTE")).alias("n_rx"),
        F.count_if(has("MEM_WRITE")).alias("n_w"),
    )


def import_tokens(imports: DataFrame, id_col: str) -> DataFrame:
    """Library and ``library:function`` tokens of an import table ``(id, library, function)``, with counts.

    A library counts once per sample, a function as often as it is listed.
    """
    lib = F.lower("library")
    libraries = imports.select(id_col, F.lit("library").alias("kind"), lib.alias("token")).distinct()
    functions = imports.select(
        id_col, F.lit("function").alias("kind"), F.concat(lib, F.lit(":"), F.col("function")).alias("token")
    )
    return libraries.unionByName(functions).groupBy(id_col, "kind", "token").agg(F.count(F.lit(1)).alias("n"))


def directory_block(entries: Column | str) -> Column:
    """First 15 ``(size, address)`` entries as one flat vector, zero-filled."""
    c = as_column(entries)
    flat = F.flatten(F.transform(c, lambda e: F.array(e["size"].cast("double"), e["address"].cast("double"))))
    return F.transform(
        F.sequence(F.lit(0), F.lit(2 * DIRECTORIES - 1)), lambda i: F.coalesce(F.get(flat, i), F.lit(0.0))
    )


def concatenated(blocks: Sequence[Column | str]) -> Column:
    """Blocks in order as one float vector."""
    return F.transform(
        F.concat(*[F.transform(as_column(b), lambda x: x.cast("double")) for b in blocks]), lambda x: x.cast("float")
    )


# The blocks of a sample's vector in order, with their widths.
BLOCKS = {
    "bytes": 256,
    "entropy": 256,
    "strings": 104,
    "general": 10,
    "header": 62,
    "sections": 255,
    "imports": 1280,
    "exports": 128,
    "directories": 30,
}
WIDTH = sum(BLOCKS.values())
# Columns of the general and the header block in order; names in brackets are hashed to that many buckets.
GENERAL = ("size", "vsize", "has_debug", "exports", "imports", "has_relocations", "has_resources", "has_signature", "has_tls", "symbols")
HEADER = (
    ("timestamp", 0),
    ("machine", 10),
    ("characteristics", 10),
    ("subsystem", 10),
    ("dll_characteristics", 10),
    ("magic", 10),
    ("major_image_version", 0),
    ("minor_image_version", 0),
    ("major_linker_version", 0),
    ("minor_linker_version", 0),
    ("major_operating_system_version", 0),
    ("minor_operating_system_version", 0),
    ("major_subsystem_version", 0),
    ("minor_subsystem_version", 0),
    ("sizeof_code", 0),
    ("sizeof_headers", 0),
    ("sizeof_heap_commit", 0),
)
SECTION_WIDTH, LIBRARY_WIDTH, FUNCTION_WIDTH = 50, 256, 1024
CLIPPED = 10_000


def offset_of(block: str) -> int:
    names = list(BLOCKS)
    return sum(BLOCKS[n] for n in names[: names.index(block)])


def _placed(df: DataFrame, id_col: str, place: Column | int, value: Column) -> DataFrame:
    place = F.lit(place) if isinstance(place, int) else place
    return df.select(id_col, place.cast("int").alias("place"), value.cast("double").alias("value"))


def _hashed(df: DataFrame, id_col: str, first: int, width: int, token: Column, value: Column | None = None) -> DataFrame:
    """One signed value per row whose token is not NULL, in the bucket of the token."""
    value = F.lit(1.0) if value is None else value
    long = df.where(token.isNotNull()).select(id_col, F.md5(token).alias("_m"), value.alias("_v"))
    return _placed(long, id_col, first + hash_bucket("_m", width), hash_sign("_m") * F.col("_v"))


def _from_arrays(df: DataFrame, id_col: str, first: int, values: Column) -> DataFrame:
    flat = df.select(id_col, F.posexplode(values).alias("_p", "_x"))
    return _placed(flat, id_col, first + F.col("_p"), F.col("_x"))


def content_block(contents: DataFrame, id_col: str, content: str) -> DataFrame:
    """``(id, place, value)``: byte and byte-entropy shares, the string block, and the size."""
    counted = contents.select(id_col, content, byte_histogram(F.col(content)).alias("_b"), byte_entropy_histogram(F.col(content)).alias("_e"))
    featured = string_features(counted.withColumn("_bytes", shares("_b")).withColumn("_entropy", shares("_e")), content)
    one = lambda c: F.array(F.col(c).cast("double"))
    strings = F.concat(
        one("numstrings"), one("avlength"), one("printables"), F.col("printabledist"),
        one("entropy"), one("paths"), one("urls"), one("registry"), one("mz"),
    )
    size = F.array(F.octet_length(content).cast("double"))
    # These blocks are next to each other, in this order, and the size is the first of the general block.
    return _from_arrays(featured, id_col, offset_of("bytes"), F.concat("_bytes", "_entropy", strings, size))


def header_block(headers: DataFrame, id_col: str) -> DataFrame:
    """``(id, place, value)`` of the general and the header columns that the table has; arrays of names are hashed."""
    first, parts = offset_of("general"), []
    plain = [(first + i, c) for i, c in enumerate(GENERAL) if c not in ("size", "exports", "imports")]
    at = offset_of("header")
    for name, width in HEADER:
        if not width:
            plain.append((at, name))
        elif name in headers.columns:
            names = F.col(name) if isinstance(headers.schema[name].dataType, T.ArrayType) else F.array(name)
            parts.append(_hashed(headers.select(id_col, F.explode(names).alias("_t")), id_col, at, width, F.col("_t")))
        at += width or 1
    there = [F.struct(F.lit(place).alias("place"), F.col(c).cast("double").alias("value")) for place, c in plain if c in headers.columns]
    if there:
        flat = headers.select(id_col, F.explode(F.array(*there)).alias("_x"))
        parts.append(_placed(flat, id_col, F.col("_x.place"), F.col("_x.value")))
    return reduce(DataFrame.unionByName, parts)


def section_block(sections: DataFrame, id_col: str) -> DataFrame:
    """``(id, place, value)`` from ``(id, name, size, vsize, entropy, props, is_entry)``: counts, then hashed names.

    Sizes, entropies and virtual sizes are added up by section name, then come the name and the properties of
    the entry section.
    """
    first, has = offset_of("sections"), lambda p: F.array_contains("props", p)
    flags = [F.lit(True), F.col("size") == 0, F.col("name") == "", has("MEM_READ") & has("MEM_EXECUTE"), has("MEM_WRITE")]
    marks = F.array(*[f.cast("double") for f in flags])
    parts, at = [_from_arrays(sections, id_col, first, marks)], first + len(flags)
    for column in ("size", "entropy", "vsize"):
        parts.append(_hashed(sections, id_col, at, SECTION_WIDTH, F.col("name"), F.col(column).cast("double")))
        at += SECTION_WIDTH
    entry = sections.where("is_entry")
    parts.append(_hashed(entry.select(id_col, "name").distinct(), id_col, at, SECTION_WIDTH, F.col("name")))
    props = entry.select(id_col, F.explode("props").alias("_t"))
    parts.append(_hashed(props, id_col, at + SECTION_WIDTH, SECTION_WIDTH, F.col("_t")))
    return reduce(DataFrame.unionByName, parts)


def import_block(imports: DataFrame, id_col: str) -> DataFrame:
    """``(id, place, value)`` from ``(id, library, function)``: libraries once each, functions as often as listed, their number."""
    tokens = import_tokens(imports.withColumn("function", F.left("function", F.lit(CLIPPED))), id_col)
    first, n = offset_of("imports"), F.col("n").cast("double")
    libraries = _hashed(tokens.where("kind = 'library'"), id_col, first, LIBRARY_WIDTH, F.col("token"))
    functions = _hashed(tokens.where("kind = 'function'"), id_col, first + LIBRARY_WIDTH, FUNCTION_WIDTH, F.col("token"), n)
    number = _placed(tokens.where("kind = 'function'"), id_col, offset_of("general") + GENERAL.index("imports"), n)
    return libraries.unionByName(functions).unionByName(number)


def export_block(exports: DataFrame, id_col: str) -> DataFrame:
    """``(id, place, value)`` from ``(id, name)``: hashed names, and their number."""
    names = _hashed(exports, id_col, offset_of("exports"), BLOCKS["exports"], F.left("name", F.lit(CLIPPED)))
    return names.unionByName(_placed(exports, id_col, offset_of("general") + GENERAL.index("exports"), F.lit(1.0)))


def directories_block(directories: DataFrame, id_col: str) -> DataFrame:
    """``(id, place, value)`` from ``(id, at, size, address)`` with places from 0; the first 15 count."""
    pair = F.array(F.col("size").cast("double"), F.col("address").cast("double"))
    flat = directories.where(F.col("at").between(0, DIRECTORIES - 1)).select(id_col, "at", F.posexplode(pair).alias("_p", "_x"))
    return _placed(flat, id_col, offset_of("directories") + 2 * F.col("at") + F.col("_p"), F.col("_x"))


def feature_values(blocks: Sequence[DataFrame], id_col: str) -> DataFrame:
    """``(id, place, value)`` with one row per place that is not zero, from blocks that may have several."""
    # Most places of most samples are zero, and add nothing to any sum.
    values = reduce(DataFrame.unionByName, blocks).where("value <> 0")
    return values.groupBy(id_col, "place").agg(F.sum("value").alias("value")).where("value <> 0")


def feature_vectors(blocks: Sequence[DataFrame], id_col: str) -> DataFrame:
    """``(id, features)``: one float vector of all blocks per sample, zero where a sample has no row in a block's table.

    Blocks are sparse tables, so they are put together by one union and aggregates by id, without a join.
    """
    found = feature_values(blocks, id_col).groupBy(id_col).agg(F.collect_list(F.struct("place", "value")).alias("_x"))
    return found.select(id_col, _filled(F.col("_x.place"), F.col("_x.value")).alias("features"))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _filled(places: pa.Array, values: pa.Array) -> pa.Array:
    """The values of each row at their places, zero elsewhere, as one flat array."""
    out = np.zeros((len(places), WIDTH), np.float32)
    row = np.repeat(np.arange(len(places)), list_sizes(places))
    out[row, places.flatten().to_numpy()] = values.flatten().to_numpy()
    return lists_of(out.reshape(-1), np.full(len(places), WIDTH), places)
