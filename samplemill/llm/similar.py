"""Near-duplicates by Jaccard similarity: wide SimHash fingerprints find candidates, shingle sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplemill.llm.graph import components, roots
from samplemill.llm.shingles import SHINGLER, mix
from samplemill.llm.simhash import sliced_pairs
from samplemill.llm.workers import byte_slices
from samplemill.plans.session import cut

SIMILARITY = 0.8
#: Words of 64 bits of a fingerprint, tables with the fewest bits of a key, and those bits.
WIDTH, TABLES, KEY_BITS = 2, 40, 14
#: Values of a bucket that are compared at once.
BUCKET = 4096
#: Shingle hashes that go with a fingerprint: the smallest ones, which are the whole set of most texts.
SKETCH = 1024
#: Rows of groups and pairs that a task decides at once, and standard errors that a partial set is given.
ROWS, PAIRS, ERRORS = 4096, 1 << 15, 4.0


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of the five-word shingles; a shorter text is one shingle, no word none."""
    words = SHINGLER.words(text or "")
    found = SHINGLER.shingles(words)
    if len(words) and not len(found):
        found = mix(np.array([np.bitwise_xor.reduce(words * (2 * np.arange(len(words), dtype=np.uint64) + np.uint64(3)))]))
    return np.unique(found)


def half(hashes: np.ndarray) -> np.ndarray:
    """Half of each hash is enough for a set: two shingles of a pair of texts hardly ever share it."""
    return np.unique(hashes.view(np.int64).astype(np.int32))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``WIDTH`` words of bits that are set in over half of the hashes, each word from hashes mixed anew."""
    out = np.zeros(WIDTH, np.uint64)
    for j in range(WIDTH):
        counts = np.zeros(64, np.int64)
        for i in range(0, len(hashes), 1 << 14):
            part = mix(hashes[i : i + (1 << 14)] + np.uint64((j + 1) * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF))
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out[j] = np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def share_of_bits(similarity: float) -> float:
    """The expected share of differing bits of two sets of equal size with that Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius(similarity: float) -> int:
    """Differing bits that a pair of the least similarity stays within in 199 of 200 cases."""
    p, n = share_of_bits(similarity), 64 * WIDTH
    return int(math.ceil(n * p + 2.6 * math.sqrt(n * p * (1 - p))))


def recall(similarity: float, bits: int, tables: int) -> float:
    """The expected share of pairs of that similarity that agree in a key and are within the radius for it."""
    p, n = share_of_bits(similarity), 64 * WIDTH
    found = 0.0
    for d in range(radius(similarity) + 1):
        agree = math.comb(n - d, bits) / math.comb(n, bits)
        found += math.comb(n, d) * p**d * (1 - p) ** (n - d) * (1 - (1 - agree) ** tables)
    return found


def tables_for(similarity: float, bits: int, tables: int = TABLES) -> int:
    """Tables with which keys of ``bits`` bits find as large a share as ``tables`` tables with the fewest bits."""
    want, most = recall(similarity, KEY_BITS, tables), tables
    while recall(similarity, bits, most) < want:
        most += 1
    return most


def _texts(docs: DataFrame) -> DataFrame:
    """``(key, fp, size, s)`` of every text that has a word: fingerprint, size of its shingle set, and its smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1):
                keys, fps, sizes, sets = [], [], [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1)):
                    hashes = shingle_set(text.as_py())
                    if len(hashes):
                        keys.append(key)
                        fps.append(wide_fingerprint(hashes).tobytes())
                        found = half(hashes)
                        sizes.append(len(found))
                        sets.append(found[:SKETCH])
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.int32)
                arrays = [pa.array(keys, pa.int64()), pa.array(fps, pa.binary()), pa.array(sizes, pa.int32())]
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "fp", "size", "s"])

    return docs.select("key", "_text").mapInArrow(run, "key long, fp binary, size int, s array<int>")


def _keyed(nodes: DataFrame, tables: int, bits: int) -> DataFrame:
    """``(node, fp, k)``: in each table, the key is a fixed random choice of the fingerprint's bits."""
    rng = np.random.default_rng(42)
    choices = np.array([rng.choice(64 * WIDTH, bits, replace=False) for _ in range(tables)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.int64(1) << np.arange(bits, dtype=np.int64)
        for batch in batches:
            bytes_ = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            on = np.unpackbits(bytes_, axis=1, bitorder="little")
            keys = np.stack([on[:, c] @ weights * tables + t for t, c in enumerate(choices)], axis=1)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables)
            lists = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["node", "fp", "ks"])

    return nodes.mapInArrow(run, "node long, fp binary, ks array<long>").select("node", "fp", F.explode("ks").alias("k"))


def _flat(column: pa.ListArray) -> tuple[pa.StructArray, np.ndarray, np.ndarray, np.ndarray]:
    """The members of all arrays of structs ``(node, fp, ...)``: nodes, fingerprints, and where each array starts."""
    flat = column.flatten()
    nodes = flat.field(0).to_numpy(zero_copy_only=False)
    values = np.frombuffer(b"".join(flat.field(1).to_pylist()), np.uint64).reshape(len(nodes), -1)
    return flat, nodes, values, column.offsets.to_numpy() - column.offsets[0].as_py()


def _groups(buckets: DataFrame, most: int) -> DataFrame:
    """``(g, node, fp)``: what pairs within the radius connect in a bucket; a group of several tables is there once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                flat, nodes, values, starts = _flat(whole.slice(i, 2000).column(0))
                root = np.arange(len(nodes))
                for a, b in sliced_pairs(values, starts, most):
                    # What is known goes in as links too, so the pairs of a dense bucket are never kept.
                    known = np.flatnonzero(root != np.arange(len(root)))
                    root = roots(len(values), np.concatenate([known, a]), np.concatenate([root[known], b]))
                order = np.lexsort((nodes, root))
                order = order[np.bincount(root, minlength=len(root))[root[order]] > 1]
                first = np.flatnonzero(np.append(True, np.diff(root[order]) != 0)) if len(order) else np.zeros(0, np.int64)
                offsets = pa.array(np.append(first, len(order)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, flat.take(pa.array(order)))], names=["vs"])

    # Groups are numbered before they are exploded.
    found = buckets.mapInArrow(run, buckets.schema).distinct().withColumn("g", F.monotonically_increasing_id())
    return found.select("g", F.explode("vs").alias("v")).select("g", "v.node", "v.fp")


def _common(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes the sets ``a[i]`` and ``b[i]`` have in common.

    Few pairs are intersected one by one. Where many pairs share few sets, every set is a row of bits, one per hash
    that several of the sets have, and words of two rows are compared at a time.
    """
    used, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    if len(a) <= 4 * len(used):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist())], np.int64)
    a, b = where[: len(a)], where[len(a) :]
    flat = np.concatenate([sets[i] for i in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    several = times > 1
    column, owner = (np.cumsum(several) - 1)[column[several[column]]], owner[several[column]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out, step = np.zeros(len(a), np.int64), 1 << 12
    for low in range(0, int(several.sum()), step):
        i, j = np.searchsorted(column, [low, low + step])
        bits = np.zeros((len(used), step), np.uint8)
        bits[owner[i:j], column[i:j] - low] = 1
        rows = np.packbits(bits, axis=1).view(np.uint64)
        for k in range(0, len(a), 4096):
            both = rows[a[k : k + 4096]] & rows[b[k : k + 4096]]
            out[k : k + 4096] += np.bitwise_count(both).sum(axis=1, dtype=np.int64)
    return out


def _judged(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs have the similarity, and which may have it but have sets that are not all there.

    Of a set that is only there in part, all hashes up to the largest one are. What two sets share up to the lower of
    these bounds is a random sample of all that they share, and is given ``ERRORS`` standard errors.
    """
    common = _common(a, b, sets)
    most = np.array([s[-1] for s in sets], np.int64)
    part = sizes > SKETCH
    bound = np.minimum(np.where(part[a], most[a], 1 << 32), np.where(part[b], most[b], 1 << 32))
    x, y = sizes[a].copy(), sizes[b].copy()
    for i in np.flatnonzero(part[a] | part[b]).tolist():
        x[i] = np.searchsorted(sets[a[i]], bound[i], "right")
        y[i] = np.searchsorted(sets[b[i]], bound[i], "right")
    union = x + y - common
    whole = ~(part[a] | part[b])
    sure = whole & (common >= similarity * union)
    slack = ERRORS * np.sqrt(similarity * (1 - similarity) * union)
    near = np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b])
    return sure, ~whole & near & (common >= similarity * union - slack)


def _links(members: DataFrame, most: int, similarity: float) -> DataFrame:
    """``(a, b, sure)`` from the rows ``(g, node, fp, size, s)`` of groups: links that have the similarity, or may have it.

    Every pair of a group within the radius is compared by its sets unless links found before connect it, and of the
    links that are sure only those that connect something new are given, so a group gives fewer of these than it
    has members. Pairs that need their full sets are all given; only texts of over ``SKETCH`` shingles have such.
    """

    def decide(rows: pa.Table) -> pa.RecordBatch:
        g, nodes, sizes = (rows.column(n).to_numpy() for n in ("g", "node", "size"))
        values = np.frombuffer(b"".join(rows.column("fp").to_pylist()), np.uint64).reshape(len(nodes), -1)
        lists = rows.column("s").combine_chunks()
        flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        sets = [flat[i:j] for i, j in zip(ends, ends[1:])]
        starts = np.append(np.flatnonzero(np.append(True, g[1:] != g[:-1])), len(g))
        root, links, open_ = np.arange(len(g)), [], []
        for a, b in sliced_pairs(values, starts, most):
            at, step = 0, ROWS
            while at < len(a):
                x, y = a[at : at + step], b[at : at + step]
                at, step = at + step, min(2 * step, PAIRS)
                apart = (root[x] != root[y]) & (nodes[x] != nodes[y])
                x, y = x[apart], y[apart]
                if not len(x):
                    continue
                sure, unsure = _judged(x, y, sizes.astype(np.int64), sets, similarity)
                known = np.flatnonzero(root != np.arange(len(root)))
                root = roots(len(g), np.concatenate([known, x[sure]]), np.concatenate([root[known], y[sure]]))
                open_.append(np.stack([x[unsure], y[unsure]]))
        known = np.flatnonzero(root != np.arange(len(root)))
        pairs = np.concatenate([np.zeros((2, 0), np.int64), *open_], axis=1)
        pairs = pairs[:, root[pairs[0]] != root[pairs[1]]]
        x, y = nodes[np.concatenate([known, pairs[0]])], nodes[np.concatenate([root[known], pairs[1]])]
        sure = np.arange(len(x)) < len(known)
        arrays = [pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y)), pa.array(sure)]
        return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "sure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                g = batch.column(0).to_numpy()
                # What comes before the batch's last group is complete, and so is what is held if that begins anew.
                last = int(np.searchsorted(g, g[-1]))
                if last:
                    yield decide(pa.Table.from_batches([*held, batch.slice(0, last)]))
                    held = []
                elif held and held[0].column(0)[0].as_py() != g[0]:
                    yield decide(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(last))
        if held:
            yield decide(pa.Table.from_batches(held))

    rows = members.select("g", "node", "fp", "size", "s").repartition("g").sortWithinPartitions("g")
    return rows.mapInArrow(run, "a long, b long, sure boolean").distinct()


def _buckets(keyed: DataFrame, limit: int) -> DataFrame:
    """Arrays of values: any two with the same key are together in one of them.

    A bucket of over ``limit`` values is cut into blocks of about half as many, and each two blocks are an array.
    """
    sizes = cut(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
    blocks = F.when(F.col("n") <= limit, 1).otherwise(F.ceil(2 * F.col("n") / limit)).cast("int")
    # The planner takes exploded rows for about as many as before, and would send all of them to the driver.
    met = keyed.hint("merge").join(sizes, "k").withColumn("blocks", blocks)
    met = met.withColumn("mine", F.pmod(F.xxhash64("node", "k"), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("mine"))
    pairs = F.transform(others, lambda x: F.struct(F.least("mine", x).alias("i"), F.greatest("mine", x).alias("j")))
    alone = F.array(F.struct(F.col("mine").alias("i"), F.col("mine").alias("j")))
    dealt = met.select("k", "node", "fp", F.explode(F.when(F.col("blocks") > 1, pairs).otherwise(alone)).alias("part"))
    return dealt.groupBy("k", "part").agg(F.collect_list(F.struct("node", "fp")).alias("vs")).where(F.size("vs") > 1).select("vs")


def _sets(docs: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, s)``: the full shingle sets of the nodes."""
    keys = texts.groupBy("node").agg(F.min("key").alias("key")).join(nodes, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1):
                sets = [half(shingle_set(t.as_py())) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int32()))], names=["node", "s"])

    found = docs.select("key", "_text").join(keys, "key").select("node", "_text").mapInArrow(run, "node long, s array<int>")
    return found.dropDuplicates(["node"])


def _verified(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The candidate pairs whose shingle sets have the similarity."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")).hint("merge"), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")).hint("merge"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, tables: int = TABLES
) -> DataFrame:
    """``(id_col, key, keep_id, keep_key)`` of the rows that are near-duplicates of a row that stays, and of no other row.

    Texts are near-duplicates if the sets of their five-word shingles have a Jaccard similarity of ``similarity`` or
    more, and so are texts that are connected through others. ``key`` is a hash of the whole text. Of each group the
    row with the smallest id stays (a row without an id after those with one, then by the key).

    Candidates agree in all sampled bits of at least one of the keys and in most of 128 bits, compared in bit
    slices. For a pair of similarity 0.8, 0.85 and 0.9 that happens with probabilities of about 0.93, 0.97 and 0.99.
    ``tables`` keys have 14 bits, up to 262,144 texts; keys get a bit more whenever the table doubles, and there
    are then so many more of them that the probability at ``similarity`` stays. Every candidate pair is decided by its
    shingle sets in the task that finds it, unless pairs decided before connect it already; pairs of texts with over
    1,024 shingles are sifted by a part of their sets there, and those that remain meet once more with all of them.

    Texts without a word are near-duplicates of nothing. Equal rows are kept or dropped together. Other columns
    are not read; an empty table gives no rows.
    """
    named = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("_text"))
    # Texts with the same set are one node; equal fingerprints of different sets are two.
    sketches = cut(_texts(named).withColumn("node", F.xxhash64("size", "s")), "wide-fingerprints")
    texts = cut(sketches.select("key", "node", "fp").distinct(), "texts")
    bits = max(KEY_BITS, math.ceil(math.log2(max(1, texts.count()))) - 4)
    keyed = _keyed(cut(texts.select("node", "fp").dropDuplicates(["node"]), "nodes"), tables_for(similarity, bits, tables), bits)
    groups = cut(_groups(_buckets(keyed, BUCKET), radius(similarity)), "groups")
    # Written, groups and sets are far smaller than as rows, so their joins are never left to broadcasts.
    wanted = sketches.select("node", "fp", "size", "s").join(groups.select("node").distinct().hint("merge"), "node", "left_semi")
    members = groups.select("g", "node").hint("merge").join(wanted.dropDuplicates(["node"]), "node")
    links = cut(_links(members, radius(similarity), similarity), "links")
    sure, unsure = links.where("sure").select("a", "b"), links.where("NOT sure").select("a", "b")
    if not unsure.isEmpty():
        asked = unsure.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sure = sure.unionByName(_verified(cut(_sets(named, texts, asked), "shingle-sets"), unsure, similarity))
    found = components(sure)
    grouped = texts.join(found, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    rows = cut(named.select("_id", "key").join(grouped, "key"), "grouped")
    order = F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("key").alias("k"))
    first = rows.groupBy("root").agg(F.min(order).alias("f"), F.max(order).alias("m")).where("f <> m").select("root", "f")
    out = rows.join(first, "root").where(order != F.col("f"))
    return out.select(F.col("_id").alias(id_col), "key", F.col("f.i").alias("keep_id"), F.col("f.k").alias("keep_key")).distinct()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates; see ``near_duplicates``."""
    dropped = cut(near_duplicates(docs, id_col, text_col, similarity), "near-duplicates")
    same = docs[id_col].eqNullSafe(dropped[id_col]) & (F.xxhash64(docs[text_col]) == dropped["key"])
    return docs.join(dropped, same, "left_anti")
