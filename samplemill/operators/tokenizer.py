"""Vocabulary training and encoding.

Training works on the table of distinct words with their counts and on postings of it, of which a
merge round reads what it touches. The vocabulary is bounded by its requested size and is the only
thing that reaches the driver.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from heapq import heappop, heappush
from itertools import chain
from operator import or_
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samplemill.functions.lists import list_sizes, list_slices, lists_of
from samplemill.functions.tokens import SPECIALS, UNK
from samplemill.plans.session import cut, work_path
from samplemill.plans.staged import exploded

PAIRS_PER_ROUND = 256
POOL = 4096
#: The largest vocabulary that is sent to tasks.
MOST_TOKENS = 2_000_000
#: Folders of postings, and files that one of them has at most.
FOLDERS, MOST_WRITERS = 32, 64
#: Ids of words that a task remembers, and what a word itself costs beside them, in ids.
CACHED_IDS, WORD_COST = 8_000_000, 60
#: Merges up to which the words of a batch are rewritten merge by merge, all at once; beyond, word by word.
MERGES_AT_ONCE = 400
#: Rounds that look for their words in the whole word table. Writing postings costs about as much as these scans.
SCANS = 64


def word_counts(df: DataFrame, words: str) -> DataFrame:
    return exploded(df, words, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def decomposition_summary(df: DataFrame, words: str) -> DataFrame:
    """Documents, words and characters that a corpus decomposes to."""
    lengths = F.aggregate(words, F.lit(0).cast("bigint"), lambda acc, w: acc + F.length(w))
    return df.agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.sum(F.size(words)).cast("bigint").alias("n_words"),
        F.sum(lengths).cast("bigint").alias("n_characters"),
    )


def word_vocabulary(counts: DataFrame, size: int, specials: Sequence[str] = SPECIALS) -> DataFrame:
    """``(token, token_id, n)``: the specials, then the ``size`` most frequent words (ties by word)."""
    spark = counts.sparkSession
    head = spark.createDataFrame([(s, i, 0) for i, s in enumerate(specials)], "token string, token_id int, n bigint")
    top = counts.orderBy(F.desc("n"), F.asc("word")).limit(size)
    # The window runs over the `size` rows left by the limit.
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), F.asc("word")))
    return head.unionByName(
        top.select(F.col("word").alias("token"), (rank + len(specials) - 1).cast("int").alias("token_id"), "n")
    )


def encode_words(df: DataFrame, words: str, vocabulary: DataFrame, out: str = "input_ids") -> DataFrame:
    """Words to ids, unknown words to ``<unk>``. Map-only: a vocabulary of up to ``MOST_TOKENS`` goes to all tasks."""
    rows = vocabulary.select("token", "token_id").limit(MOST_TOKENS + 1).collect()
    if len(rows) > MOST_TOKENS:
        raise ValueError(f"the vocabulary has more than {MOST_TOKENS} tokens")
    table = {r.token: r.token_id for r in rows}
    shared = df.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("array<int>")
    def encode(lists: pa.Array) -> pa.Array:
        ids = shared.value

        def coded(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            return np.array([ids.get(w, UNK) for w in values.to_pylist()], np.int32), np.ones(len(values), np.int64)

        return _encoded(lists, coded)

    return df.withColumn(out, encode(F.col(words)))


#: Words that a Python worker handles at once.
WORDS_AT_ONCE = 1 << 16


def _encoded(lists: pa.Array, coded: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Ids of lists of words, NULL for NULL, as one flat array; ``coded`` gives the ids of distinct words and how many each has.

    Words are looked at in parts, and distinct ones once per part: no word of a row becomes an object of its own.
    """
    flat, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for part in list_slices(lists, WORDS_AT_ONCE):
        held = list_sizes(part)
        found = part.flatten().dictionary_encode("encode")
        codes = found.indices.to_numpy()
        ids, many = coded(found.dictionary)
        starts, n = np.cumsum(many) - many, many[codes]
        ends = np.cumsum(n)
        # Where the ids of every word start, and from there one after the other.
        flat.append(ids[np.repeat(starts[codes] - ends + n, n) + np.arange(n.sum())])
        sizes.append(np.diff(np.append(0, ends)[np.append(0, np.cumsum(held))]))
    return lists_of(np.concatenate(flat), np.concatenate(sizes), lists)


@dataclass
class Merges:
    """A trained pair-merge vocabulary: tokens in id order and merges in rank order."""

    tokens: list[str]
    merges: list[tuple[str, str]]
    prefix: str = ""
    ids: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        self.ids = {t: i for i, t in enumerate(self.tokens)}


class Pair(NamedTuple):
    a: str
    b: str
    n: int


def _joined(left: str, right: str, prefix: str) -> str:
    return left + (right.removeprefix(prefix) if prefix else right)


def _independent(pairs: Sequence[Pair], prefix: str, known: set[str], floor: int) -> list[tuple[str, str]]:
    """The leading pairs of a sorted list that one-by-one merging would take in the same order.

    A merge changes only pairs that share a symbol with it, and a pair it creates is at most
    as frequent as one of those. So pairs may be merged together down to the first pair that
    shares a symbol with an earlier one, as long as they are strictly more frequent than it and
    than ``floor``, the most that a pair outside the list may have.
    """
    taken: list[Pair] = []
    touched: set[str] = set()
    barrier = floor
    for row in pairs:
        token = _joined(row.a, row.b, prefix)
        if touched & {row.a, row.b}:
            barrier = max(barrier, row.n)
            break
        taken.append(row)
        if row.a == row.b or token in known:
            barrier = max(barrier, row.n)
            break
        touched |= {row.a, row.b, token}
    return [(r.a, r.b) for i, r in enumerate(taken) if i == 0 or r.n > barrier]


def _ranks(merges: Sequence[tuple[str, str]]) -> dict[tuple[str, str], list[int]]:
    """The places of every pair in the list of merges, ascending; a pair may be merged again later on."""
    ranks: dict[tuple[str, str], list[int]] = {}
    for i, pair in enumerate(merges):
        ranks.setdefault(pair, []).append(i)
    return ranks


def merge_symbols(parts: list[str], ranks: dict[tuple[str, str], list[int]], prefix: str = "", again: bool = True) -> list[str]:
    """Merge the adjacent pair of lowest rank, all its occurrences from the left, until none is known.

    With ``again`` a merge may lead to pairs of a lower rank, which go next (encoding). Without it every merge
    of the list is applied once, in order, which gives the symbols at that point of the training. Symbols are a linked
    list, and pairs wait in a heap, so that a word of any length takes ``n log n`` steps.
    """
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, str, str]] = []

    def offer(i: int, done: int) -> None:
        j = after[i]
        found = ranks.get((parts[i], parts[j])) if j < n else None
        if found is not None:
            at = 0 if again else bisect_right(found, done)
            if at < len(found):
                heappush(heap, (found[at], i, parts[i], parts[j]))

    for i in range(n - 1):
        offer(i, -1)
    while heap:
        rank, changed = heap[0][0], []
        while heap and heap[0][0] == rank:
            _, i, a, b = heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = _joined(a, b, prefix), "", after[j]
            if after[j] < n:
                before[after[j]] = i
            changed.append(i)
        for i in changed:
            offer(i, rank)
            if before[i] >= 0:
                offer(before[i], rank)
    return [p for p in parts if p]


def _letters(word: str, prefix: str) -> list[str]:
    return [c if i == 0 else prefix + c for i, c in enumerate(word)]


#: Changed pairs that a task holds before it passes them on.
HELD_PAIRS = 200_000


class _Spelling:
    """Words of a batch as one text with a character per symbol, so that a merge is one replacement in all of them.

    Letters inside a word stand for themselves; first letters (if marked apart), tokens and the bound between words
    get characters that no word has. Pairs are two characters in one number.
    """

    def __init__(self, alphabet: Sequence[str], merges: Sequence[tuple[str, str]], prefix: str):
        letters = {s[-1] for s in alphabet}
        free = (chr(i) for i in chain(range(0xD800), range(0xE000, 0x110000)) if chr(i) not in letters)
        self.prefix, self.bound = prefix, next(free)
        self.codes = {s: s[-1] if s.startswith(prefix) and len(s) > len(prefix) else next(free) for s in alphabet}
        for a, b in merges:
            token = _joined(a, b, prefix)
            if token not in self.codes:
                self.codes[token] = next(free)
        self.names = {c: s for s, c in self.codes.items()}

    def text(self, words: list[str], merges: Sequence[tuple[str, str]]) -> str:
        """The words after the merges, each applied once, in order."""
        if len(merges) > MERGES_AT_ONCE:
            ranks = _ranks(merges)
            found = ("".join(self.codes[s] for s in merge_symbols(_letters(w, self.prefix), ranks, self.prefix, False)) for w in words)
            return self.bound + self.bound.join(found) + self.bound
        spelled = (self.codes[w[0]] + w[1:] for w in words) if self.prefix else words
        return self.merged(self.bound + self.bound.join(spelled) + self.bound, merges)

    def merged(self, text: str, merges: Sequence[tuple[str, str]]) -> str:
        for a, b in merges:
            text = text.replace(self.codes[a] + self.codes[b], self.codes[_joined(a, b, self.prefix)])
        return text

    def pairs(self, text: str, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Neighbours in every word, and the word's count."""
        at = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        bound = at == ord(self.bound)
        here = ~(bound[:-1] | bound[1:])
        return at[:-1][here] << 21 | at[1:][here], n[(np.cumsum(bound) - 1)[:-1][here]]

    def named(self, pairs: np.ndarray) -> list[list[str]]:
        return [[self.names[chr(c)] for c in side.tolist()] for side in (pairs >> 21, pairs & (1 << 21) - 1)]


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum per key, but for those that are zero."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sums = np.add.reduceat(values[order], first)
    return keys[first][sums != 0], sums[sums != 0]


def _counted(words: DataFrame, spelling: _Spelling, changes: Callable[[list[str], np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``(a, b, n)``: the sum of what ``changes`` says of pairs for the words ``(word, n)`` of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        found = none, none

        def rows() -> pa.RecordBatch:
            arrays = [*(pa.array(side, pa.string()) for side in spelling.named(found[0])), pa.array(found[1], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "n"])

        for batch in batches:
            more = changes(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False))
            found = _summed(*(np.concatenate(x) for x in zip(found, more)))
            if len(found[0]) > HELD_PAIRS:
                yield rows()
                found = none, none
        yield rows()

    pairs = words.select("word", "n").mapInArrow(run, "a string, b string, n bigint")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _pair_counts(words: DataFrame, alphabet: Sequence[str], merges: Sequence[tuple[str, str]], prefix: str) -> DataFrame:
    """Neighbouring symbols of all words after the given merges."""
    spelling = _Spelling(alphabet, merges, prefix)

    def pairs(batch: list[str], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return spelling.pairs(spelling.text(batch, merges), n)

    return _counted(words, spelling, pairs).where("n > 0")


def _words_with(words: DataFrame, pairs: Sequence[tuple[str, str]], prefix: str) -> DataFrame:
    """``(word, n)`` of all words that may have one of the pairs, by a scan."""
    raw = {"".join(x.removeprefix(prefix) for x in pair) for pair in pairs}
    return words.where(reduce(or_, [F.contains("word", F.lit(x)) for x in sorted(raw)]))


class _Index:
    """The words by the pairs of letters in them: a posting is the word itself, in the folder of its pair of letters.

    Symbols of a word are a function of the word and the merges so far, so no round ever rewrites it. A merge of two
    symbols happens only in words that have the last letter of the first next to the first letter of the second, and
    a round reads only the folders of such pairs of letters.
    """

    def __init__(self, words: DataFrame, prefix: str):
        self.prefix = prefix
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2))))
        rows = exploded(words.where(F.length("word") > 1), grams, "gram", ["word", "n"])
        rows = rows.withColumn("g", self._folder(F.col("gram")))
        # A folder has many files, so that the words of a frequent pair of letters are read by many tasks.
        writers = min(MOST_WRITERS, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        spread = F.pmod(F.xxhash64("word"), F.lit(writers))
        path = work_path(words.sparkSession, "postings")
        rows.repartition("g", spread).sortWithinPartitions("g", "gram").write.partitionBy("g").parquet(path)
        self.rows = words.sparkSession.read.schema("word string, n bigint, gram string, g int").parquet(path)

    @staticmethod
    def _folder(gram: Column) -> Column:
        return (F.crc32(gram.cast("binary")) % FOLDERS).cast("int")

    def words_with(self, pairs: Sequence[tuple[str, str]]) -> DataFrame:
        """``(word, n)`` of all words that may have one of the pairs, once each."""
        raw = [tuple(x.removeprefix(self.prefix) for x in pair) for pair in pairs]
        grams = [a[-1] + b[0] for a, b in raw]
        # Of the postings of a word, that of the first pair that it has counts.
        first = F.lit(None).cast("string")
        for (a, b), gram in reversed(list(zip(raw, grams))):
            first = F.when(F.contains("word", F.lit(a + b)), F.lit(gram)).otherwise(first)
        folders = {crc32(g.encode()) % FOLDERS for g in grams}
        here = F.col("g").isin(sorted(folders)) & F.col("gram").isin(sorted(set(grams)))
        return self.rows.where(here & (F.col("gram") == first)).select("word", "n")


class _Pool:
    """The most frequent pairs with their exact counts; all other pairs have ``floor`` at most."""

    def __init__(self, counted: DataFrame, prefix: str, max_length: int | None):
        self.prefix, self.max_length = prefix, max_length
        if max_length is not None:
            counted = counted.where(F.length("a") + F.length("b") - len(prefix) <= max_length)
        rows = counted.orderBy(F.desc("n"), "a", "b").limit(POOL + 1).collect()
        self.floor = rows[POOL].n if len(rows) > POOL else 0
        self.counts = {(r.a, r.b): r.n for r in rows[:POOL]}

    def best(self) -> list[Pair]:
        """Pairs that are certainly the most frequent ones, in merge order; none if the words must be counted anew."""
        pairs = [Pair(a, b, n) for (a, b), n in self.counts.items() if n > self.floor]
        return sorted(pairs, key=lambda p: (-p.n, p.a, p.b))[:PAIRS_PER_ROUND]

    def apply(self, changes: Sequence, fresh: set[str]) -> None:
        """Count changes of a round, after which ``fresh`` are new tokens: their pairs have all occurrences among the changes."""
        floor = self.floor
        for a, b, n in changes:
            if (a, b) in self.counts:
                self.counts[a, b] += n
            elif self.max_length is None or len(a) + len(b) - len(self.prefix) <= self.max_length:
                if a not in fresh and b not in fresh:
                    # A second way to spell an old token adds to pairs outside the pool.
                    floor = max(floor, self.floor + n)
                elif n > self.floor:
                    self.counts[a, b] = n
        self.floor = floor


def train_merges(
    counts: DataFrame,
    size: int | None = None,
    max_length: int | None = None,
    prefix: str = "",
    specials: Sequence[str] = SPECIALS,
    merges: int | None = None,
) -> Merges:
    """Byte-pair vocabulary from ``(word, n)``: of ``size`` entries beyond the specials, or with ``merges`` merged pairs.

    The pairs of all words are counted once, and the ``POOL`` most frequent ones kept. Every round merges the most
    frequent pair, ties by text, together with all following pairs that do not interact with it, and counts pairs
    only in the words that have one of them, before and after. Such words are found by a scan of the word table, and
    by postings once there have been ``SCANS`` rounds. Pairs outside the pool
    have a bound that changes raise, so all is counted again no sooner than the best pair is as rare as that. With
    ``prefix`` symbols inside a word carry a continuation mark. The driver holds the pool and per round the changes,
    which the vocabulary bounds.
    """
    if (size is None) == (merges is None):
        raise ValueError("either the size of the vocabulary or the number of merges")
    # A word table is small, so the number of tasks is set here instead of being left to its size in bytes.
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = cut(counts.where(F.length("word") > 0).select("word", "n").repartition(tasks, "word"), "words")
    symbols = F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0))
    if prefix:
        symbols = F.transform(symbols, lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.lit(prefix), c)))
    alphabet = [r.s for r in words.select(F.explode(F.array_distinct(symbols)).alias("s")).distinct().collect()]
    tokens = [*specials, *sorted(alphabet)]
    known, done = set(tokens), []
    index, scans = None, 0
    pool = _Pool(_pair_counts(words, alphabet, done, prefix), prefix, max_length)

    def missing() -> int:
        return merges - len(done) if size is None else size + len(specials) - len(tokens)

    while missing() > 0:
        top = pool.best()
        if not top and pool.floor:
            pool = _Pool(_pair_counts(words, alphabet, done, prefix), prefix, max_length)
            top = pool.best() or [Pair(a, b, n) for (a, b), n in pool.counts.items()][:1]
        if not top:
            break
        floor = top[-1].n if len(top) == PAIRS_PER_ROUND else pool.floor
        chosen = _independent(top, prefix, known, floor)[: missing()]
        fresh = {_joined(a, b, prefix) for a, b in chosen} - known
        if missing() > len(chosen):
            if scans < SCANS:
                scans, touched = scans + 1, _words_with(words, chosen, prefix)
            else:
                index = index or _Index(words, prefix)
                touched = index.words_with(chosen)
            pool.apply(_changes(touched, alphabet, done, chosen, prefix).collect(), fresh)
        done += chosen
        for token in (_joined(a, b, prefix) for a, b in chosen):
            if token not in known:
                known.add(token)
                tokens.append(token)
    return Merges(tokens, done, prefix)


def _changes(words: DataFrame, alphabet: Sequence[str], done: Sequence[tuple[str, str]], chosen: Sequence[tuple[str, str]], prefix: str) -> DataFrame:
    """``(a, b, n)``: by how much the count of a pair differs once ``chosen`` are merged, too."""
    done, spelling = tuple(done), _Spelling(alphabet, [*done, *chosen], prefix)

    def pairs(batch: list[str], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        old = spelling.text(batch, done)
        sides = spelling.pairs(old, -n), spelling.pairs(spelling.merged(old, chosen), n)
        return tuple(np.concatenate(x) for x in zip(*sides))

    return _counted(words, spelling, pairs).where("n <> 0")


def encode_merges(df: DataFrame, words: str, model: Merges, out: str = "input_ids") -> DataFrame:
    """Apply a trained vocabulary to word arrays. Map-only; each task caches the words it has seen."""
    ranks = _ranks(model.merges)
    shared = df.sparkSession.sparkContext.broadcast((model.ids, ranks, model.prefix))

    @F.arrow_udf("array<int>")
    def encode(lists: pa.Array) -> pa.Array:
        ids, known_ranks, prefix = shared.value
        cache: dict[str, array] = {}
        held = 0

        def ids_of(word: str | None) -> array:
            nonlocal held
            if not word:
                return array("i")
            found = cache.get(word)
            if found is None:
                if held >= CACHED_IDS:
                    cache.clear()
                    held = 0
                found = cache[word] = array("i", [ids.get(s, UNK) for s in merge_symbols(_letters(word, prefix), known_ranks, prefix)])
                held += len(found) + WORD_COST
            return found

        def coded(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            all_ids, many = array("i"), []
            for word in values.to_pylist():
                found = ids_of(word)
                all_ids.extend(found)
                many.append(len(found))
            return np.array(all_ids, np.int32), np.array(many, np.int64)

        return _encoded(lists, coded)

    return df.withColumn(out, encode(F.col(words)))


def length_sweep(df: DataFrame, encoded: dict[str, str]) -> DataFrame:
    """Sequence lengths under several tokenisers side by side: ``(config, length, n)``."""
    sizes = F.array(*[F.struct(F.lit(k).alias("config"), F.size(c).alias("length")) for k, c in encoded.items()])
    return (
        df.select(F.explode(sizes).alias("_s"))
        .groupBy("_s.config", "_s.length")
        .agg(F.count(F.lit(1)).alias("n"))
    )
