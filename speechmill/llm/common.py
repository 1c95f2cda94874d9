"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The white space that splits words and is stripped from lines: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def wide_hash(value: Column) -> list[Column]:
    """Two independent 64-bit hashes: the second one starts from another seed."""
    return [F.xxhash64(value), F.xxhash64(F.lit("second"), value)]


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir, made known to checkpoint().

    Only where the session names none (tests on one machine) is a folder under
    /tmp used instead.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"/tmp/checkpoints/{uuid.uuid4().hex}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def settled(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that few texts are Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def words_of(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a UTF-8 text, A-Z lower-cased."""
    return text.lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def parts_for(total: int, each: int) -> int:
    """How many parts of about `each` units hold `total` units."""
    return max(1, -(-int(total) // each))


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 texts of an Arrow column as bytes; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def add_columns(docs: DataFrame, text_col: str, fields: list[tuple[str, str]], make) -> DataFrame:
    """docs with further columns that each task computes from the texts.

    ``make()`` is called once per task and returns a function from a list of
    UTF-8 texts to one Arrow array (or list) per field. New columns replace
    columns of the same name; nothing is shuffled.
    """
    names = [n for n, _ in fields]
    kept = [c for c in docs.columns if c not in names or c == text_col]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema
    for name, kind in fields:
        schema = schema.add(name, StructType.fromDDL(f"x {kind}")["x"].dataType)
    arrow = to_arrow_schema(schema)

    def run(batches):
        compute = make()
        for batch in slices(batches):
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            made = compute(bytes_of(batch.column(batch.schema.get_field_index(text_col))))
            made = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, arrow.field(n).type)
                    for n, x in zip(names, made, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [c if c.type == f.type else c.cast(f.type) for c, f in zip([*columns, *made], arrow, strict=True)], schema=arrow)

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)
