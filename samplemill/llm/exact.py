"""Exact de-duplication in batches: static filters screen incoming digests, positives meet exact buckets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplemill.llm.workers import free_names
from samplemill.plans.session import cut

SPACE = b" \t\n\v\f\r"
#: Digests per filter on average: a filter of about 300 KB.
SHARD = 1 << 18


class FuseFilter:
    """A static binary-fuse filter over distinct 64-bit keys: three 8-bit slots per key, 1/256 false positives.

    The slots of a key lie in three neighbouring segments. Keys are peeled in rounds: all slots that only one
    key uses are taken off at once, and filled in the opposite order. Seeds are tried until all keys come off.
    """

    def __init__(self, slots: np.ndarray, segment: int, seed: int):
        self.slots, self.segment, self.seed = slots, segment, seed

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        n = max(1, len(keys))
        # Sizes of the published construction for three slots per key.
        segment = 1 << min(18, max(2, int(np.log(n) / np.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(2, n)))
        segments = max(1, -(-int(n * factor) // segment))
        for seed in range(1000):
            made = cls(np.zeros((segments + 2) * segment, np.uint8), segment, seed)
            if made._fill(keys):
                return made
        raise RuntimeError("no seed fits; are the keys distinct?")

    def _hash(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = keys + np.uint64((self.seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
            h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
        starts = np.uint64(len(self.slots) - 2 * self.segment)
        first = ((h >> np.uint64(32)) * starts) >> np.uint64(32)
        size, mask = np.uint64(self.segment), np.uint64(self.segment - 1)
        places = np.stack([first, (first + size) ^ (h >> np.uint64(18) & mask), (first + size + size) ^ (h & mask)])
        return places.astype(np.int64), (h ^ h >> np.uint64(32)).astype(np.uint8)

    def _fill(self, keys: np.ndarray) -> bool:
        places, mark = self._hash(keys)
        users = np.bincount(places.ravel(), minlength=len(self.slots))
        # The xor of the users of a slot is its user once only one is left.
        who = np.zeros(len(self.slots), np.int64)
        for row in places:
            np.bitwise_xor.at(who, row, np.arange(len(keys)))
        rounds, left = [], len(keys)
        while left:
            free = np.flatnonzero(users == 1)
            taken, first = np.unique(who[free], return_index=True)
            if not len(taken):
                return False
            rounds.append((taken, free[first]))
            left -= len(taken)
            for row in places[:, taken]:
                np.subtract.at(users, row, 1)
                np.bitwise_xor.at(who, row, taken)
        for taken, slot in reversed(rounds):
            a, b, c = places[:, taken]
            self.slots[slot] = 0
            self.slots[slot] = mark[taken] ^ self.slots[a] ^ self.slots[b] ^ self.slots[c]
        return True

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        (a, b, c), mark = self._hash(keys)
        return self.slots[a] ^ self.slots[b] ^ self.slots[c] == mark


def with_digests(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``(*keep, sha, size)``: SHA-256 of the text without ASCII white space, code points of the original text."""
    schema = docs.select(*keep).schema.add("sha", "binary").add("size", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, sizes = [], []
            for text in batch.column(len(keep)):
                text = text.as_py() or ""
                shas.append(hashlib.sha256(text.encode().translate(None, SPACE)).digest())
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(shas, pa.binary()), pa.array(sizes, pa.int64())], names=schema.names
            )

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def _bodies(docs: DataFrame) -> DataFrame:
    """``(sha, body)``: the normalised bytes of every ``_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                bodies = [(t.as_py() or "").encode().translate(None, SPACE) for t in batch.slice(i, 1000).column(0)]
                shas = [hashlib.sha256(b).digest() for b in bodies]
                yield pa.RecordBatch.from_arrays([pa.array(shas, pa.binary()), pa.array(bodies, pa.binary())], names=["sha", "body"])

    return docs.select("_text").mapInArrow(run, "sha binary, body binary")


def build_filters(digests: DataFrame, shards: int) -> DataFrame:
    """``(shard, slots, segment, seed)``: one filter per shard of the distinct 64-bit ``key`` of a snapshot."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        made = FuseFilter.build(np.unique(part["key"].to_numpy().view(np.uint64)))
        return pd.DataFrame(
            {"shard": part["shard"].iloc[:1], "slots": [made.slots.tobytes()], "segment": [made.segment], "seed": [made.seed]}
        )

    keyed = digests.select("key", F.expr(f"pmod(key, {shards})").cast("int").alias("shard"))
    return keyed.groupBy("shard").applyInPandas(run, "shard int, slots binary, segment long, seed long")


def screen(digests: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The rows of ``digests`` (with ``key``) that may be in the snapshot of the filters; no other row is in it."""
    columns = digests.columns

    def run(rows: pd.DataFrame, filter_row: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or filter_row.empty:
            return rows.iloc[:0][columns]
        slots, segment, seed = filter_row[["slots", "segment", "seed"]].iloc[0]
        made = FuseFilter(np.frombuffer(slots, np.uint8), int(segment), int(seed))
        return rows.loc[made.maybe(rows["key"].to_numpy().view(np.uint64)), columns]

    keyed = digests.withColumn("shard", F.expr(f"pmod(key, {shards})").cast("int"))
    return keyed.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(run, digests.schema)


def dedup_exact(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    batches: int = 2,
    shard: int = SHARD,
) -> DataFrame:
    """``(id_col, keep_id, group_size, kept, text_sha256, text_key)``, one row per row of ``docs``.

    Texts are equal if they are identical without ASCII white space. Of equal texts the one with the most code
    points stays, then the smallest id. The table arrives in ``batches`` parts (dealt by a hash of the id). A
    batch is grouped by digest on its own first. Its distinct digests are then screened by the static filters
    of the snapshot of all earlier batches; only positives are joined with the exact digests of the snapshot,
    and false positives end there. Then the bytes are checked: every text of a digest that occurs more than once
    is grouped by its bytes, and two byte strings under one digest raise an error.

    NULL counts as the empty text. Rows with a NULL id are kept as rows; at equal length an id goes before NULL.
    Of rows that repeat the same id and length one stays. Other columns are not read; an empty table gives no rows.
    ``text_key`` is a hash of the original text.
    """
    named = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("_text"))
    dealt = named.withColumn("_batch", F.expr(f"pmod(xxhash64(_id), {batches})").cast("int"))
    digests = with_digests(dealt, "_text", ["_id", "_key", "_batch"]).withColumn("_row", F.monotonically_increasing_id())
    table = cut(digests, "digests")
    order = F.struct((-F.col("size")).alias("s"), F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("_row").alias("r"))
    grouped = table.groupBy("_batch", "sha").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n"))
    grouped = cut(grouped.withColumn("key", F.conv(F.substring(F.hex("sha"), 1, 15), 16, 10).cast("long")), "batches")
    shards = max(1, -(-grouped.count() // shard))

    snapshot = grouped.where("_batch = 0").drop("_batch")
    for i in range(1, batches):
        incoming = grouped.where(F.col("_batch") == i).drop("_batch")
        filters = cut(build_filters(snapshot, shards), "filters")
        positive = screen(incoming.select("sha", "key"), filters, shards)
        known = cut(positive.select("sha").join(snapshot.select("sha"), "sha", "left_semi"), "known")
        new = incoming.join(known, "sha", "left_anti")
        met = snapshot.unionByName(incoming.join(known, "sha", "left_semi"))
        met = met.groupBy("sha", "key").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        snapshot = cut(met.unionByName(new), "snapshot")

    groups = snapshot.where("n > 1").select("sha", F.struct("best.i", "best.r", "n").alias("g"))
    bodies = _bodies(named).join(groups.select("sha"), "sha", "left_semi")
    variants = bodies.groupBy("sha", "body").agg(F.count(F.lit(1)).alias("n")).groupBy("sha").agg(F.count(F.lit(1)).alias("v"))
    clash = F.raise_error(F.lit("two texts have one SHA-256 digest"))
    checked = groups.join(variants, "sha").select("sha", F.when(F.col("v") == 1, F.col("g")).otherwise(clash).alias("g"))
    # Written first: a join of two shuffled tables is one whose hot digests can be split.
    out = table.join(cut(checked, "groups"), "sha", "left")
    return out.select(
        F.col("_id").alias(id_col),
        F.when(F.col("g").isNull(), F.col("_id")).otherwise(F.col("g.i")).alias("keep_id"),
        F.coalesce("g.n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("g.r") == F.col("_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("_key").alias("text_key"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the rows that ``dedup_exact`` keeps, all columns as they are.

    Rows are found again by their id and text. If rows repeat both, one of them stays.
    """
    marked = cut(dedup_exact(docs, id_col, text_col).select(F.col(id_col).alias("_i"), F.col("text_key").alias("_k"), "kept"), "exact")
    rows = marked.groupBy("_i", "_k").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    gone = rows.where("NOT kept")
    same = docs[id_col].eqNullSafe(gone["_i"]) & (F.xxhash64(docs[text_col]) == gone["_k"])
    out = docs.join(gone, same, "left_anti")
    if rows.where("kept AND n > 1").isEmpty():
        return out
    # Only a table with repeated rows pays for telling them apart.
    (digest,) = free_names(docs.columns, "_text_hash")
    return out.withColumn(digest, F.xxhash64(text_col)).dropDuplicates([id_col, digest]).drop(digest)
