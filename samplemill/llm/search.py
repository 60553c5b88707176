"""Ranked lexical search: bundles of items carry sparse accumulators through the owners of terms, rarest terms first."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samplemill.plans.session import cut

TOP = 50
#: A term belongs to the first owner whose share of documents it does not exceed; the last owner has the others.
OWNERS = (0.01, 0.1, 0.4)
#: Items and their terms that go through the owners together, on average: the bound of what tasks are sent.
PASS_ITEMS, PASS_TERMS = 512, 200_000
#: Documents, bytes of text, and postings after which a block of documents ends.
BLOCK_DOCS, BLOCK_BYTES, BLOCK_HITS = 8192, 32 << 20, 1 << 20
#: What a posting takes: place in the block, times the term occurs, terms of the document.
HIT = np.dtype([("at", "<u2"), ("tf", "<u4"), ("n", "<u4")])

#: Letters A-Z in lower case, digits, and all that is not ASCII; every other character separates terms.
TERM = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode().translate(TERM).split()


def _item_terms(items: DataFrame) -> DataFrame:
    """``(item, terms)``: the distinct terms of every item that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms(t.as_py() or ""))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item", "terms"])

    return items.select("item", "_text").mapInArrow(run, "item long, terms array<binary>").where(F.size("terms") > 0)


def _index(docs: DataFrame, vocabulary: dict[bytes, int], id_type: T.DataType) -> DataFrame:
    """``(block, term, hits, ids, n)``: per block of documents and term the postings; with term 0 the documents' ids.

    ``n`` is the number of documents of a row of postings, and that of all terms in a block's own row.
    """
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("term", T.IntegerType())])
    schema = schema.add("hits", "binary").add("ids", T.ArrayType(id_type)).add("n", "long")

    def emit(block: int, ids: list, sizes: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        arrow_ids = pa.concat_arrays(ids)
        keys, tf = np.unique(np.concatenate(found), return_counts=True)
        at, n = (keys % BLOCK_DOCS).astype(np.int64), np.array(sizes)
        hits = np.empty(len(keys), HIT)
        hits["at"], hits["tf"], hits["n"] = at, tf, n[at]
        firsts = np.flatnonzero(np.append(True, np.diff(keys // BLOCK_DOCS) != 0)) if len(keys) else np.zeros(0, np.int64)
        ends = np.append(firsts[1:], len(keys))
        body = hits.tobytes()
        rows = [body[a * HIT.itemsize : b * HIT.itemsize] for a, b in zip(firsts.tolist(), ends.tolist())]
        k = len(firsts) + 1
        lists = pa.ListArray.from_arrays(pa.array([0, len(arrow_ids), *[len(arrow_ids)] * (k - 1)], pa.int32()), arrow_ids)
        counts = pa.array([int(n.sum()), *(ends - firsts).tolist()], pa.int64())
        of = pa.array([0, *(keys[firsts] // BLOCK_DOCS).tolist()], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([block] * k, pa.int64()), of, pa.array([b"", *rows], pa.binary()), lists, counts], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids, sizes, found, size, hits = [], [], [], 0, 0
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                words = terms(text.as_py() or "")
                if not words:
                    continue
                known = np.fromiter(map(vocabulary.get, words, repeat(0)), np.int64, len(words))
                known = known[known > 0]
                ids.append(batch.column(0).slice(i, 1))
                found.append(known * BLOCK_DOCS + len(sizes))
                sizes.append(len(words))
                size += 8 * len(words)
                hits += len(known)
                if len(sizes) == BLOCK_DOCS or size > BLOCK_BYTES or hits > BLOCK_HITS:
                    yield emit(block, ids, sizes, found)
                    block, ids, sizes, found, size, hits = block + 1, [], [], [], 0, 0
        if sizes:
            yield emit(block, ids, sizes, found)

    return docs.select("_id", "_text").mapInArrow(run, schema)


def _shares(hits: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a posting is worth per unit of its term's weight."""
    tf, n = hits["tf"].astype(np.int64), hits["n"].astype(np.int64)
    m = 50 + (50 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _largest(postings: DataFrame, n_docs: int, n_terms: int) -> dict[int, int]:
    """The largest share of a posting of every term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = [int(_shares(np.frombuffer(h.as_py(), HIT), n_docs, n_terms).max()) for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(most, pa.int64())], names=["term", "most"])

    found = postings.select("term", "hits").mapInArrow(run, "term int, most long").groupBy("term").agg(F.max("most").alias("most"))
    return dict(found.collect())


class Bundle:
    """The items of a pass: who has a term, term weights, and what later owners can still add to an item."""

    def __init__(self, items: list[list[int]], weights: dict[int, int], owner: dict[int, int], largest: dict[int, int]):
        self.weights = weights
        self.size = len(items)
        self.having: dict[int, np.ndarray] = {}
        for i, own in enumerate(items):
            for t in own:
                self.having.setdefault(t, []).append(i)
        self.having = {t: np.array(x) for t, x in self.having.items()}
        self.rest = np.zeros((len(OWNERS) + 2, len(items)), np.int64)
        for i, own in enumerate(items):
            for t in own:
                if t in owner:
                    self.rest[: owner[t] + 1, i] += weights[t] * largest[t]


def _unpack(accumulators: pa.Table, out: np.ndarray) -> None:
    """Add the accumulators of a block to the table of items by documents."""
    for at, score in zip(accumulators.column("at").to_pylist(), accumulators.column("score").to_pylist()):
        at = np.frombuffer(at, "<u4")
        out[at >> 16, at & 0xFFFF] += np.frombuffer(score, "<i8")


def _added(left: pa.Table, right: pa.Table, bundle: Bundle, n_docs: int, n_terms: int) -> np.ndarray:
    """The accumulators of a block, items by documents, after one owner's contributions."""
    out = np.zeros((bundle.size, BLOCK_DOCS), np.int64)
    _unpack(left, out)
    for term, hits in zip(right.column("term").to_pylist(), right.column("hits").to_pylist()):
        if term:
            hits = np.frombuffer(hits, HIT)
            out[bundle.having[term][:, None], hits["at"][None, :]] += bundle.weights[term] * _shares(hits, n_docs, n_terms)
    return out


def _through(accumulators: DataFrame, postings: DataFrame, bundle: Bundle, stage: int, least: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """``(block, at, score)`` after one owner: only accumulators that can still reach ``least``, their item's bound."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = _added(left, right, bundle, n_docs, n_terms)
        item, doc = np.nonzero((out > 0) & (out + bundle.rest[stage + 1][:, None] >= least[:, None]))
        block = (right if right.num_rows else left).column("block")[0].as_py()
        at = (item.astype("<u4") << 16 | doc.astype("<u4")).astype("<u4").tobytes()
        return pa.table({"block": [block], "at": [at], "score": [out[item, doc].astype("<i8").tobytes()]}, pa.schema([("block", pa.int64()), ("at", pa.binary()), ("score", pa.binary())]))

    return accumulators.groupBy("block").cogroup(postings.groupBy("block")).applyInArrow(run, "block long, at binary, score binary")


def _bounds(accumulators: DataFrame, bundle: Bundle, top: int) -> np.ndarray:
    """Per item a score that its ``top``-th best document certainly reaches; 0 as long as there are fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0, np.int64)] * bundle.size
        for batch in batches:
            for at, score in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                item, score = np.frombuffer(at, "<u4") >> 16, np.frombuffer(score, "<i8")
                order = np.argsort(item, kind="stable")
                for i, own in zip(*_split(item[order], score[order])):
                    both = np.concatenate([best[i], own])
                    best[i] = -np.partition(-both, top - 1)[:top] if len(both) > top else both
        items = np.repeat(np.arange(bundle.size), [len(b) for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(np.concatenate(best), pa.int64())], names=["i", "score"])

    w = Window.partitionBy("i").orderBy(F.desc("score"))
    found = accumulators.select("at", "score").mapInArrow(run, "i long, score long").withColumn("r", F.row_number().over(w))
    out = np.zeros(bundle.size, np.int64)
    for r in found.where(F.col("r") <= top).where(F.col("r") == top).collect():
        out[r.i] = r.score
    return out


def _split(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Sorted keys, and the values of each."""
    firsts = np.flatnonzero(np.append(True, np.diff(keys) != 0)) if len(keys) else np.zeros(0, np.int64)
    return keys[firsts].tolist(), np.split(values, firsts[1:]) if len(keys) else []


def _selected(accumulators: DataFrame, postings: DataFrame, bundle: Bundle, top: int, n_docs: int, n_terms: int, id_type: T.DataType) -> DataFrame:
    """``(i, id, score)`` after the last owner: the best documents of every item in each block."""
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("id", id_type), T.StructField("score", T.LongType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = _added(left, right, bundle, n_docs, n_terms)
        own = right.filter(pc.equal(right.column("term"), 0)).column("ids").combine_chunks().flatten()
        # Ties with the last of the best stay, for the ids to decide.
        width = out.shape[1]
        worst = np.partition(out, width - top, axis=1)[:, width - top] if top < width else np.zeros(len(out))
        item, doc = np.nonzero((out > 0) & (out >= worst[:, None]))
        table = pa.table([pa.array(item, pa.int64()), own.take(pa.array(doc)), pa.array(out[item, doc], pa.int64())], names=schema.names)
        table = table.take(pc.sort_indices(table, [("i", "ascending"), ("score", "descending"), ("id", "ascending")]))
        item = table.column("i").to_numpy()
        place = np.arange(len(item)) - np.searchsorted(item, item)
        return table.filter(pa.array(place < top))

    return accumulators.groupBy("block").cogroup(postings.groupBy("block")).applyInArrow(run, schema)


def _one_pass(docs: DataFrame, items: list, top: int) -> DataFrame:
    """``(item, id, score)``: the best documents per block for the items ``(item, terms)`` of one pass."""
    spark, id_type = docs.sparkSession, docs.schema["_id"].dataType
    vocabulary = {t: k for k, t in enumerate(sorted({bytes(t) for r in items for t in r.terms}), 1)}
    index = cut(_index(docs, vocabulary, id_type), "postings")
    whole = index.where("term = 0").agg(F.sum(F.size("ids")).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = whole.docs or 0, whole.terms or 0
    postings = index.where("term > 0")
    frequency = dict(postings.groupBy("term").agg(F.sum("n").alias("n")).collect())
    largest = _largest(postings, n_docs, n_terms)

    weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in frequency.items()}
    owner = {t: sum(df > share * n_docs for share in OWNERS) for t, df in frequency.items()}
    bundle = Bundle([[vocabulary[bytes(t)] for t in r.terms] for r in items], weights, owner, largest)
    owners = F.broadcast(spark.createDataFrame([(0, len(OWNERS)), *owner.items()], "term int, owner int"))
    index = index.join(owners, "term")

    accumulators = spark.createDataFrame([], "block long, at binary, score binary")
    least = np.zeros(len(items), np.int64)
    for stage in range(len(OWNERS)):
        owned = index.where(F.col("owner") == stage).select("block", "term", "hits")
        accumulators = cut(_through(accumulators, owned, bundle, stage, least, n_docs, n_terms), "accumulators")
        least = np.maximum(least, _bounds(accumulators, bundle, top))
    owned = index.where(F.col("owner") == len(OWNERS)).select("block", "term", "hits", "ids")
    found = _selected(accumulators, owned, bundle, top, n_docs, n_terms, id_type)
    names = F.broadcast(spark.createDataFrame([(i, r.item) for i, r in enumerate(items)], "i long, item long"))
    return found.join(names, "i").select("item", "id", "score")


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    top: int = TOP,
) -> DataFrame:
    """``(item_col, rank, id_col, score)``: the ``top`` documents with the highest scores above 0 for every item.

    Terms are maximal runs of ASCII letters, digits and all characters beyond ASCII, with A-Z in lower case. The
    weight of a term is ``floor(1000 ln((2N + 2) / (2 df + 1)))``; all further arithmetic is in 64-bit integers, so
    the order in which contributions are added does not matter. Equal scores are ordered by ascending id.

    Documents are cut into blocks, with one row of postings per block and term of an item. Terms have owners, by how
    frequent they are. The items go as a bundle from owner to owner, rarest terms first, once per block: a cogroup of
    the bundle's accumulators with the owner's postings of that block adds the contributions. After each owner
    the ``top``-th best partial score of an item is a bound that its result reaches. An accumulator that
    cannot reach it with the largest contributions of all terms to come is let go, which never changes the result.
    After the last owner, the best of each block are ranked.

    More than about ``PASS_ITEMS`` items or ``PASS_TERMS`` terms go in several passes, so what tasks are sent is
    bounded. Every item row has its own ranks, repeated rows too; items without a term have none. NULL texts have no
    term; documents without one are not counted. Documents with a NULL id are ranked after equal scores with one, and
    repeated rows are documents of their own. Other columns are not read. An empty table gives no rows.
    """
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    asked = items.select(F.col(item_col).alias("_item"), F.col(item_text_col).alias("_text"))
    asked = cut(asked.withColumn("item", F.monotonically_increasing_id()), "items")
    wanted = cut(_item_terms(asked), "item-terms")
    total = wanted.agg(F.count(F.lit(1)).alias("items"), F.sum(F.size("terms")).alias("terms")).first()
    passes = max(1, -(-total["items"] // PASS_ITEMS), -(-(total["terms"] or 0) // PASS_TERMS))
    parts = []
    for p in range(passes):
        some = wanted.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == p).orderBy("item").collect()
        if some:
            parts.append(_one_pass(named, some, top))
    if not parts:
        kind = named.schema["_id"].dataType
        found = docs.sparkSession.createDataFrame([], T.StructType([T.StructField("item", T.LongType()), T.StructField("id", kind), T.StructField("score", T.LongType())]))
    else:
        found = reduce(DataFrame.unionByName, parts)
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    out = ranked.join(asked.select("item", "_item"), "item")
    return out.select(F.col("_item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
