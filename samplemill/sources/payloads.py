"""Decoding compressed payloads by their signature."""

from __future__ import annotations

import bz2
import gzip
import lzma
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Signatures in the order in which they are tried, and the names of the codecs.
SIGNATURES = {
    "gzip": b"\x1f\x8b\x08",
    "bz2": b"\x42\x5a\x68",
    "xz": b"\xfd7zXZ\x00",
    "zlib": b"x\x9c",
}
CODECS = {"bz2": bz2.decompress, "gzip": gzip.decompress, "xz": lzma.decompress, "zlib": zlib.decompress}
POLICIES = ("raise", "empty", "skip")


def _decode(data: bytes) -> tuple[str, bytes | None, str | None]:
    """Codec, content, error. A known signature must decode; other data tries all codecs, then stays as it is."""
    for name, signature in SIGNATURES.items():
        if data.startswith(signature):
            try:
                return name, CODECS[name](data), None
            except Exception as error:  # noqa: BLE001
                return name, None, str(error)
    if data.startswith(b"7z"):
        return "7z", None, "7z is not supported"
    for name, codec in CODECS.items():
        try:
            return name, codec(data), None
        except Exception:  # noqa: BLE001
            continue
    return "none", data, None


def decoded(df: DataFrame, id_col: str, content: str, errors: str = "raise", max_length: int | None = None) -> DataFrame:
    """``(id, alg, bytes, error)``. Errors raise, give empty content or drop the row.

    Content longer than ``max_length`` after decoding is left out.
    """
    if errors not in POLICIES:
        raise ValueError(f"unknown policy: {errors}")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_decode(bytes(b)) for b in batch["content"]]
            yield pd.DataFrame(
                {"id": batch["id"], "alg": [r[0] for r in rows], "bytes": [r[1] for r in rows], "error": [r[2] for r in rows]}
            )

    source = df.select(F.col(id_col).cast("string").alias("id"), F.col(content).cast("binary").alias("content"))
    out = source.where("content is not null").mapInPandas(decode, "id string, alg string, bytes binary, error string")
    if errors == "raise":
        failed = F.raise_error(F.concat_ws(" ", "id", "error")).cast("binary")
        out = out.withColumn("bytes", F.when(F.col("error").isNotNull(), failed).otherwise(F.col("bytes")))
    elif errors == "empty":
        out = out.withColumn("bytes", F.coalesce("bytes", F.lit(b"")))
    else:
        out = out.where("error is null")
    return out if max_length is None else out.where(F.octet_length("bytes") <= max_length)
