"""Language identification: scripts narrow the candidates, a Viterbi path over words labels spans."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samplemill.llm.shingles import mix
from samplemill.llm.workers import byte_slices, use_caches
from samplemill.plans.session import cut

UNKNOWN = "und"
#: Rows per language from which the model is learnt, on average, and the features that it keeps.
SAMPLE = 2000
FEATURES = 200_000
#: Labels are a small closed set; more of them mean that the column is no language.
MAX_LANGUAGES = 1000
ORDERS = (1, 2, 3)
#: What a change of language costs, and the most that one word can say against a language (nats).
PENALTY, WORST = 12.0, 10.0
#: Bytes of the table that tasks are sent: with very many languages, fewer features are kept.
MODEL_BYTES = 64 << 20
#: Bytes that a Python worker keeps of words and their scores, and what a word takes besides its scores.
CACHE, ENTRY = 40 << 20, 160

WORD = re.compile(r"[^\W\d_]+")

# First code points of script ranges, and the script from there on ("" is none of them).
RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, ""), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, ""),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, ""), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, ""),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x2C60, "latin"), (0x2C80, ""), (0x2DE0, "cyrillic"),
    (0x2E00, ""), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"),
    (0x31F0, "kana"), (0x3200, ""), (0x3400, "han"), (0xA000, ""), (0xA640, "cyrillic"), (0xA6A0, ""),
    (0xA720, "latin"), (0xA800, ""), (0xAC00, "hangul"), (0xD800, ""), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, ""), (0xFE70, "arabic"), (0xFF00, "latin"),
    (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, ""), (0x20000, "han"), (0x32000, ""),
)
_STARTS = [a for a, _ in RANGES]


def script(word: str) -> str:
    """The script of most letters of a word; the first to reach that count on a tie."""
    if max(word) < "\u0370":
        return "latin"
    return Counter(RANGES[bisect_right(_STARTS, ord(c)) - 1][1] for c in word).most_common(1)[0][0]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of one to three characters of lower-case words between boundary marks, and whose they are."""
    marked = [f"<{w.lower()}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) for w in marked], np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters from here to the end of the word
    hashes, whose = [], []
    running = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        keep = left >= n
        running = running[keep] * np.uint64(0xD6E8FEB86659FD93)
        starts = np.flatnonzero(keep) if n == 1 else starts[keep]
        running += codes[starts + n - 1] + np.uint64(1)
        left, word = left[keep], word[keep]
        if n in ORDERS:
            # The length is in the lowest bits.
            hashes.append(mix(running) & ~np.uint64(7) | np.uint64(n))
            whose.append(word)
    return np.concatenate(hashes), np.concatenate(whose)


@dataclass
class Model:
    """Log-probabilities of features (sorted hashes) per language, and the languages that each script leaves."""

    languages: list[str]
    hashes: np.ndarray
    table: np.ndarray
    candidates: dict[str, np.ndarray]
    known: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None
    letters: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "scores": None, "letters": None}

    def _learn(self, words: list[str]) -> None:
        """Scores of new words: the mean over the feature lengths, relative to the best candidate language."""
        hashes, whose = features(words)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = self.hashes[at] == hashes
        at, whose = at[found], whose[found]
        score = np.stack([np.bincount(whose, column[at], len(words)) for column in self.table.T], axis=1) / len(ORDERS)
        of = np.array([script(w) for w in words])
        for name in set(of.tolist()) & set(self.candidates):
            score[np.ix_(np.flatnonzero(of == name), np.flatnonzero(~self.candidates[name]))] = -np.inf
        score = np.maximum(score - score.max(axis=1, keepdims=True), -WORST)
        letters = np.array([len(w) if w.isalpha() else sum(c.isalpha() for c in w) for w in words], np.int64)
        score[letters == 0] = 0
        first = len(self.known)
        self.known.update(zip(words, range(first, first + len(words))))
        if self.scores is None:
            self.scores, self.letters = score, letters
        else:
            self.scores, self.letters = np.concatenate([self.scores, score]), np.concatenate([self.letters, letters])

    def numbers(self, words: list[str]) -> np.ndarray:
        """Places of words in ``scores`` and ``letters``."""
        if len(self.known) * (ENTRY + 16 * len(self.languages)) > CACHE:
            self.known, self.scores, self.letters = {}, None, None
        known = self.known
        new = [w for w in set(words) if w not in known]
        if new:
            self._learn(new)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def steady(scores: np.ndarray, sizes: np.ndarray, best: np.ndarray, penalty: float) -> np.ndarray:
    """Texts whose best path certainly never changes the language.

    In each stretch of another language, a path gains at most that language's largest stretch sum over the best
    single language. ``k`` such stretches need ``k - 1`` changes at least, and one of them alone over the whole text
    gains nothing. So if no stretch gains more than half the penalty, no path with a change is better.
    """
    text = np.repeat(np.arange(len(sizes)), sizes)
    firsts = np.cumsum(sizes) - sizes
    out = np.ones(len(sizes), bool)
    # Each text starts far below the one before it, so that running minima begin anew.
    drop = text * (2 * WORST * (int(sizes.max()) + 2))
    mine = scores[np.arange(len(text)), best[text]]
    for k in range(scores.shape[1]):
        gain = np.cumsum(scores[:, k] - mine)
        before = np.concatenate([[0.0], gain[:-1]])
        gain -= np.repeat(before[firsts], sizes) + drop
        before = np.concatenate([[0.0], gain[:-1]])
        before[firsts] = -drop[firsts]
        out &= np.maximum.reduceat(gain - np.minimum.accumulate(before), firsts) <= penalty / 2
    return out


def paths(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """The language of every word on the best path of its text; all texts take their steps together."""
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    longest = int(sizes.max())
    active = np.searchsorted(-sizes[order], -np.arange(1, longest + 1), "right")
    back = np.zeros(scores.shape, np.int16)
    value = np.zeros((len(sizes), scores.shape[1]))
    each = np.arange(scores.shape[1], dtype=np.int16)
    for t in range(longest):
        k = active[t]
        at, v = starts[:k] + t, value[:k]
        if t:
            top = v.argmax(axis=1).astype(np.int16)
            moved = v[np.arange(k), top] - penalty
            change = moved[:, None] > v
            back[at] = np.where(change, top[:, None], each)
            v = np.where(change, moved[:, None], v)
        value[:k] = v + scores[at]
    labels = np.zeros(len(scores), np.int16)
    state = value.argmax(axis=1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        labels[at] = state[:k]
        state[:k] = back[at, state[:k]]
    return labels


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, most: int = FEATURES) -> Model:
    """Learn from about ``sample`` rows per language, taken by a hash of the text, in whole texts.

    Rows with a NULL text or language are left out. Features are counted on the cluster; what the driver gets is
    bounded by ``most`` features, and by the languages times the scripts. A language is a candidate for a script
    if at least one in a hundred of its letters belongs to it.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(1, np.uint64), np.zeros((1, 0)), {})
    most = min(most, MODEL_BYTES // (8 * len(languages)))
    full = 1 << 30
    bound = F.lit(full)
    for lang, n in sizes.items():
        if n > sample:
            bound = F.when(F.col("lang") == lang, F.lit(int(full * sample / n))).otherwise(bound)
    chosen = labelled.where(F.pmod(F.xxhash64("text"), F.lit(full)) < bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words.setdefault(lang, Counter()).update(WORD.findall(text.as_py()))
            for lang, counted in words.items():
                if not counted:
                    continue
                times = np.fromiter(counted.values(), np.int64, len(counted))
                hashes, whose = features(list(counted))
                distinct, inverse = np.unique(hashes, return_inverse=True)
                n = np.bincount(inverse, times[whose]).astype(np.int64)
                scripts: Counter = Counter()
                for word, t in counted.items():
                    scripts[script(word)] += t * len(word)
                names = [None] * len(distinct) + list(scripts)
                f = [*distinct.view(np.int64).tolist(), *[0] * len(scripts)]
                arrays = [pa.array([lang] * len(f)), pa.array(f, pa.int64()), pa.array(names, pa.string())]
                arrays.append(pa.array([*n.tolist(), *scripts.values()], pa.int64()))
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "f", "script", "n"])

    counted = chosen.mapInArrow(run, "lang string, f long, script string, n long")
    counted = cut(counted.groupBy("f", "script", "lang").agg(F.sum("n").alias("n")), "features")
    scripts = counted.where("script IS NOT NULL").collect()
    wide = counted.where("script IS NULL").groupBy("f").agg(
        F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("of")
    )
    rows = wide.where("n > 1").orderBy(F.desc("n"), "f").limit(most).collect()
    hashes = np.array([r["f"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    hashes = hashes[order]
    place = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((len(rows), len(languages)))
    for i, o in enumerate(order.tolist()):
        for lang, n in rows[o]["of"].items():
            counts[i, place[lang]] = n
    # Probabilities among the features of the same length, which is in the lowest bits of a hash.
    table = np.zeros((max(1, len(rows)), len(languages)))
    for n in ORDERS:
        own = np.flatnonzero((hashes & np.uint64(7)) == np.uint64(n))
        table[own] = np.log((counts[own] + 0.5) / (counts[own].sum(axis=0) + 0.5 * max(1, len(own))))
    hashes = hashes if len(rows) else np.zeros(1, np.uint64)
    letters: dict[str, np.ndarray] = {}
    for r in scripts:
        letters.setdefault(r.script, np.zeros(len(languages)))[place[r.lang]] = r.n
    total = sum(letters.values(), np.zeros(len(languages)))
    candidates = {s: n >= 0.01 * total for s, n in letters.items() if (n >= 0.01 * total).any()}
    return Model(languages, hashes, table, candidates)


def _labelled(texts: list[str], model: Model, penalty: float) -> list[tuple[str, float, str]]:
    """``(language, share of the letters, spans)`` of each text."""
    words = [WORD.findall(t) if model.languages else [] for t in texts]
    full = [i for i, ws in enumerate(words) if ws]
    out = [(UNKNOWN, 0.0, "")] * len(texts)
    if not full:
        return out
    sizes = np.array([len(words[i]) for i in full], np.int64)
    numbers = model.numbers([w for i in full for w in words[i]])
    scores, letters = model.scores[numbers].astype(np.float64), model.letters[numbers]
    firsts = np.cumsum(sizes) - sizes
    best = np.add.reduceat(scores, firsts, axis=0).argmax(axis=1)
    labels = np.repeat(best, sizes).astype(np.int16)
    alike = steady(scores, sizes, best, penalty)
    rest = ~np.repeat(alike, sizes)
    if rest.any():
        labels[rest] = paths(scores[rest], sizes[~alike], penalty)
    for j, i in enumerate(full):
        part = slice(firsts[j], firsts[j] + sizes[j])
        if not letters[part].any():
            continue
        if alike[j]:
            lang, share, changes = int(best[j]), 1.0, np.zeros(1, np.int64)
        else:
            weight = np.bincount(labels[part], letters[part], len(model.languages))
            lang, share = int(weight.argmax()), float(weight.max() / weight.sum())
            changes = np.flatnonzero(np.append(True, labels[part][1:] != labels[part][:-1]))
        if len(changes) == 1:
            spans = f"{model.languages[labels[firsts[j]]]}:0:{len(texts[i])}"
        else:
            starts = [m.start() for m in WORD.finditer(texts[i])]
            cuts = [0, *(starts[c] for c in changes[1:]), len(texts[i])]
            names = [model.languages[labels[firsts[j] + c]] for c in changes]
            spans = ",".join(f"{n}:{a}:{b}" for n, a, b in zip(names, cuts, cuts[1:]))
        out[i] = model.languages[lang], share, spans
    return out


def with_language(
    docs: DataFrame,
    model: Model,
    text_col: str = "text",
    penalty: float = PENALTY,
    names: tuple[str, str, str] = ("lang_pred", "score", "spans"),
) -> DataFrame:
    """``docs`` with the columns of ``names`` appended; only the text is an input of the prediction.

    Words are maximal runs of letters. Every word has a score per language from its features; languages that do
    not use the word's script get the worst score. The path through the whole text that maximises the sum of the
    scores, less ``penalty`` per change of language, labels every word, and with that spans of the text
    (``language:start:end`` in code points, comma-joined). The first new column is the language of most letters
    (the first in order on a tie), the second its share of them. A text that is NULL or has no letter is ``und`` with score 0
    and no spans, and so is every text if nothing was learnt. Rows and other columns stay as they are, repeated rows
    and NULLs in other columns too; columns named like the new ones are replaced. An empty table gives no rows.
    """
    docs = docs.drop(*names)
    new = [T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.StringType()))]
    schema = T.StructType([*docs.schema.fields, *new])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_caches("language")
        for batch in batches:
            for part in byte_slices(batch, at):
                rows = _labelled([t or "" for t in part.column(at).to_pylist()], model, penalty)
                lang, score, spans = zip(*rows)
                arrays = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=schema.names)

    return docs.mapInArrow(run, schema)


def held_out(id_col: str):
    """Whether a row is kept from training: CRC-32 of its id as text leaves 1 by 3. False for a NULL id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``(id_col, held_out, lang_pred, score, spans)``, one row per row of ``docs``; see ``with_language``.

    The model is learnt from the rows that are not held out and have an id and a language.
    """
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    named = named.withColumn("held_out", held_out("_id"))
    model = train(named.where("_id IS NOT NULL AND NOT held_out"), "_text", "_lang", sample)
    found = with_language(named.select("_id", "_text", "held_out"), model, "_text")
    return found.select(F.col("_id").alias(id_col), "held_out", "lang_pred", "score", "spans")
