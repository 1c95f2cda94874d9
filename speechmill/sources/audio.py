"""WAV files as rows of header fields and samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("length", T.LongType()), T.StructField("modified_ms", T.LongType()),
    T.StructField("sha256", T.StringType()), T.StructField("channels", T.IntegerType()), T.StructField("bits", T.IntegerType()),
    T.StructField("rate", T.IntegerType()), T.StructField("samples", T.ArrayType(T.ShortType())), T.StructField("error", T.StringType()),
])


def decode_wav(data: bytes) -> tuple[int, int, int, np.ndarray | None]:
    """Channels, bits, rate and (for mono 16-bit PCM) samples of a RIFF file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt = 12, None
    while at + 8 <= len(data):
        name, size = data[at:at + 4], int.from_bytes(data[at + 4:at + 8], "little")
        body = data[at + 8:at + 8 + size]
        if name == b"fmt ":
            code, channels, rate = (int.from_bytes(body[i:j], "little") for i, j in ((0, 2), (2, 4), (4, 8)))
            fmt = (channels, int.from_bytes(body[14:16], "little"), rate, code)
        elif name == b"data":
            if fmt is None:
                break
            channels, bits, rate, code = fmt
            plain = code == 1 and bits == 16 and channels == 1
            return channels, bits, rate, np.frombuffer(body[:len(body) // 2 * 2], "<i2") if plain else None
        at += 8 + size + size % 2
    raise ValueError("no PCM data")


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """A mono 16-bit WAV file."""
    body = np.asarray(samples, dtype="<i2").tobytes()
    fmt = b"".join(v.to_bytes(n, "little") for v, n in ((1, 2), (1, 2), (rate, 4), (rate * 2, 4), (2, 2), (16, 2)))
    return (b"RIFF" + (36 + len(body)).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + fmt
            + b"data" + len(body).to_bytes(4, "little") + body)


def read_wavs(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """All WAV files under ``path``; an unreadable one becomes a row with ``error``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return decode_files(files.select("path", "length", F.unix_millis("modificationTime").alias("modified_ms"), "content"))


def decode_files(files: DataFrame) -> DataFrame:
    """Header fields and samples of files(path, length, modified_ms, content)."""
    listed = files.select("path", "length", "modified_ms", F.sha2("content", 256).alias("sha256"), "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content in batch.column("content"):
                try:
                    channels, bits, rate, samples = decode_wav(content.as_py())
                    rows.append((channels, bits, rate, samples, None))
                except ValueError as error:
                    rows.append((None, None, None, None, str(error)))
            cols = list(zip(*rows)) if rows else [[], [], [], [], []]
            types = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int16()), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("path", "length", "modified_ms", "sha256")] + [pa.array(list(c), t) for c, t in zip(cols, types)],
                names=[f.name for f in HEADER.fields])

    return listed.mapInArrow(decode, HEADER)
