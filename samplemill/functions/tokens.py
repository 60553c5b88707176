"""Token id arrays: bytes to ids, special tokens, padding, multi-hot labels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samplemill.functions.ids import as_column
from samplemill.functions.lists import lists_of

# The special tokens, in id order.
SPECIALS = ("<pad>", "<unk>", "<msk>", "<bos>", "<eos>", "<cls>", "<sep>")
PAD, UNK, MSK, BOS, EOS, CLS, SEP = range(len(SPECIALS))
RAW_WORD_BYTES = 16
#: Contents that are converted to ids at once.
ROWS_AT_ONCE = 500
#: Bytes that are read together for integers of so many bits, and integers that they give.
GROUPS = {8: (1, 1), 12: (3, 2), 16: (2, 1)}

# One token: a hex prefix, a hex digit, a run of other word characters, or a single symbol.
LISTING_TOKEN = r"0x|[0-9A-F]|[a-zG-Z_]+|[^a-zA-Z0-9_\s]"


def byte_words(content: Column | str) -> Column:
    """Fixed chunks of 16 bytes."""
    c = as_column(content).cast("binary")
    chunks = F.ceil(F.octet_length(c) / RAW_WORD_BYTES).cast("int")
    return F.when(
        chunks > 0,
        F.transform(
            F.sequence(F.lit(0), chunks - 1),
            lambda i: F.substring(c, i * RAW_WORD_BYTES + 1, F.lit(RAW_WORD_BYTES)),
        ),
    ).otherwise(F.array().cast("array<binary>"))


def line_words(text: Column | str) -> Column:
    return F.split(as_column(text), "\n")


def listing_tokens(text: Column | str) -> Column:
    """Pre-tokens of a listing: hex digits and symbols alone, white space removed."""
    return F.regexp_extract_all(as_column(text), F.lit(LISTING_TOKEN), F.lit(0))


def byte_ids(content: Column | str, bits: int = 8) -> Column:
    """Bytes as unsigned integers of 8, 12 or 16 bits; short tails are padded with zero bytes.

    The second value of a 12-bit pair has the low nibble of the middle byte as its high part.
    """
    if bits not in (8, 12, 16):
        raise ValueError(f"unsupported width: {bits}")

    def convert(contents: pa.Array) -> pa.Array:
        # One array for the whole batch, filled part by part.
        group, per_group = GROUPS[bits]
        lengths = pc.fill_null(pc.binary_length(contents), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = -(-lengths // group) * per_group
        flat, at = np.empty(int(sizes.sum()), np.int32), 0
        for low in range(0, len(contents), ROWS_AT_ONCE):
            bodies = [b or b"" for b in contents.slice(low, ROWS_AT_ONCE).to_pylist()]
            found = _integers(b"".join(b + bytes(-len(b) % group) for b in bodies), bits)
            flat[at : at + len(found)] = found
            at += len(found)
        return lists_of(flat, sizes, contents)

    return F.arrow_udf(convert, "array<int>")(as_column(content).cast("binary"))


def with_byte_ids(df: DataFrame, content: str, widths: Sequence[int] = (8, 12, 16), name: str = "ids") -> DataFrame:
    """``df`` with the columns ``ids_8``, ``ids_12`` and so on: ``byte_ids`` of several widths in one pass.

    A batch of contents is converted as a whole: each list column is one flat array and its offsets.
    """
    if set(widths) - {8, 12, 16}:
        raise ValueError(f"unsupported widths: {widths}")
    schema = T.StructType([*df.schema.fields, *(T.StructField(f"{name}_{w}", T.ArrayType(T.IntegerType())) for w in widths)])
    at = df.columns.index(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(i, ROWS_AT_ONCE)
                contents = batch.column(at).cast(pa.binary())
                bodies = [b or b"" for b in contents.to_pylist()]
                arrays = []
                for bits in widths:
                    group, per_group = GROUPS[bits]
                    flat = _integers(b"".join(b + bytes(-len(b) % group) for b in bodies), bits)
                    sizes = [-(-len(b) // group) * per_group for b in bodies]
                    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(contents.is_null().to_numpy(zero_copy_only=False), False))
                    arrays.append(pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())))
                yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=schema.names)

    return df.mapInArrow(run, schema)


def _integers(b: bytes, bits: int) -> np.ndarray:
    group = GROUPS[bits][0]
    b += bytes(-len(b) % group)
    if bits == 16:
        return np.frombuffer(b, dtype="<u2").astype(np.int32)
    values = np.frombuffer(b, dtype=np.uint8).astype(np.int32)
    if bits == 8:
        return values
    first, middle, last = values.reshape(-1, 3).T
    return np.stack([first * 16 + middle // 16, middle % 16 * 256 + last], axis=1).reshape(-1)


def input_ids(
    ids: Column | str,
    shift: int = 0,
    max_length: int | None = None,
    cls: int | None = None,
    bos: int | None = None,
    eos: int | None = None,
) -> Column:
    """Shift ids past the specials, put ``cls`` or ``bos`` in front, truncate, end with ``eos``."""
    if cls is not None and bos is not None:
        raise ValueError("either cls or bos, not both")
    out = F.transform(as_column(ids), lambda x: x + shift)
    front = cls if cls is not None else bos
    if front is not None:
        out = F.concat(F.array(F.lit(front)), out)
    if max_length is not None:
        out = F.slice(out, 1, max_length - (eos is not None))
    if eos is not None:
        out = F.concat(out, F.array(F.lit(eos)))
    return out


def padded(ids: Column | str, length: int, pad: int = PAD) -> Column:
    """Truncate or pad to a fixed length."""
    c = F.slice(as_column(ids), 1, length)
    return F.concat(c, F.array_repeat(F.lit(pad), F.lit(length) - F.size(c)))


def padded_to_multiple(ids: Column | str, multiple: int, pad: int = PAD) -> Column:
    c = as_column(ids)
    return F.concat(c, F.array_repeat(F.lit(pad), F.pmod(-F.size(c), F.lit(multiple))))


def with_template(
    ids: Column | str, pair: Column | str | None = None, start: int | None = BOS, end: int | None = EOS
) -> Column:
    """``start A end`` or ``start A end <sep> start B end``."""
    head = [F.array(F.lit(start))] if start is not None else []
    tail = [F.array(F.lit(end))] if end is not None else []
    parts = [*head, as_column(ids), *tail]
    if pair is not None:
        parts += [F.array(F.lit(SEP)), *head, as_column(pair), *tail]
    return F.concat(*parts)


def multi_hot(labels: Column | str, classes: int) -> Column:
    """Label ids to a 0/1 vector."""
    c = as_column(labels)
    return F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.array_contains(c, i).cast("float")
    )


def windows(ids: Column | str, length: int, stride: int = 0) -> Column:
    """Consecutive windows of ``length`` ids that overlap by ``stride``; the last may be shorter."""
    if not 0 <= stride < length:
        raise ValueError("the overlap must be shorter than the window")
    c = as_column(ids)
    step = length - stride
    last = F.greatest(F.lit(0), F.ceil((F.size(c) - length) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(c, i * step + 1, F.lit(length)))


def chunk_index(ids: Column | str, size: int) -> Column:
    """For each position the number of the chunk it lies in."""
    return F.transform(as_column(ids), lambda _, i: F.floor(i / size).cast("bigint"))
