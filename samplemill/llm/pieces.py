"""SentencePiece encoding and decoding with vectorised merge rounds."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplemill.llm.merges import MergeTable

BLANK = "▁"
#: Entries of the cache of encoded words in a Python worker.
CACHE = 400_000


class PieceCoder:
    """Ids and texts of a byte-pair model with byte fallback, read through the library."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = sp = SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        special = [sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) for i in range(self.size)]
        self.ids = {sp.id_to_piece(i): i for i in range(self.size) if not special[i]}
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.ids):
            raise ValueError("a piece of the model reaches across words")
        scores = sorted({sp.get_score(i) for i in self.ids.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        pairs = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                left, right = self._symbol(piece[:k]), self._symbol(piece[k:])
                if left is not None and right is not None:
                    pairs[left, right] = rank[sp.get_score(i)], i
        self.table = MergeTable(pairs)
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.surface = [b"" if special[i] else sp.id_to_piece(i).replace(BLANK, " ").encode() for i in range(self.size)]
        for b, i in enumerate(self.bytes):
            self.surface[i] = bytes([b])
        self.words = re.compile(f"{BLANK}*[^{BLANK}\n]+|\n|{BLANK}+")
        self.known: dict[str, bytes] = {}

    def _symbol(self, part: str) -> int | None:
        """A piece, or a single character: one that is no piece has a number beyond the pieces."""
        found = self.ids.get(part)
        return self.size + ord(part) if found is None and len(part) == 1 else found

    def _learn(self, words: list[str]) -> None:
        chars = sorted(set("".join(words)))
        singles = np.array([self._symbol(c) for c in chars], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        symbols = singles[np.searchsorted(np.array([ord(c) for c in chars], np.uint32), codes)]
        final, sizes = self.table.run(symbols, np.array([len(w) for w in words], np.int64))
        ends = np.cumsum(sizes)
        body = final.astype("<u4").tobytes()
        for word, a, b in zip(words, (4 * (ends - sizes)).tolist(), (4 * ends).tolist()):
            self.known[word] = body[a:b]
        # Characters that the model does not have are spelt in bytes.
        for w in np.unique(np.searchsorted(ends, np.flatnonzero(final >= self.size), "right")).tolist():
            part = final[ends[w] - sizes[w] : ends[w]].tolist()
            spelt = [[s] if s < self.size else self.bytes[list(chr(s - self.size).encode())] for s in part]
            self.known[words[w]] = np.concatenate(spelt).astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text between the begin and end ids.

        Texts are normalised by the library. No piece reaches across the start of a run of blanks or a line feed, so
        words between them are encoded once each.
        """
        parts = [self.words.findall(self.model.normalize(t)) for t in texts]
        if len(self.known) > CACHE:
            self.known = {}
        new = list({w for words in parts for w in words if w not in self.known})
        for i in range(0, len(new), 20_000):
            self._learn(new[i : i + 20_000])
        first, last = (np.array([i], "<u4").tobytes() for i in (self.begin, self.end))
        known = self.known
        return [np.frombuffer(b"".join([first, *[known[w] for w in words], last]), "<u4") for words in parts]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids that ``encode`` gave: blanks for their sign, without the one that was put in front."""
        surface = self.surface
        body = b"".join([surface[i] for i in ids.tolist()])
        inner = ids[(ids != self.begin) & (ids != self.end)][:1].tolist()
        if inner and self.surface[inner[0]].startswith(b" "):
            body = body[1:]
        return body.decode("utf-8", "replace")


_CODERS: dict[str, PieceCoder] = {}


def coder(path: str) -> PieceCoder:
    """One per Python worker and file."""
    if path not in _CODERS:
        _CODERS[path] = PieceCoder(path)
    return _CODERS[path]


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``(id_col, ids, decoded)``: ids of whole texts with begin and end ids, and the text decoded from them.

    Ids equal those of the library for a byte-pair model with byte fallback. A NULL text is empty: only the begin and
    end ids. NULL ids and repeated rows stay as rows, other columns are not read, an empty table gives no rows.
    """
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    schema = named.select("_id").schema.add("ids", "binary").add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, texts in _coded(batches, path):
            arrays = [part.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return named.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``(id_col, n_tokens, ids_sha256, decoded_sha256)`` of what ``encode_decode`` gives, without sending it back."""
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    schema = named.select("_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, texts in _coded(batches, path):
            arrays = [
                part.column(0),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return named.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def _coded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[str]]]:
    pieces = coder(path)
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            ids = pieces.encode([t.as_py() or "" for t in part.column(1)])
            yield part, ids, [pieces.decode(x) for x in ids]
