"""What the corpus operators share: byte tables, shared-folder staging, Arrow plumbing."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depweave.plans.staging import discard, remove, shared_folder, stage  # noqa: F401


#: A-Z to a-z, every other byte as it is (also the bytes of other UTF-8 letters).
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
UPPER_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: [\x20\x09-\x0D], which is also what bytes.split() and bytes.strip() take as white space.
SPACE_CHARS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids give -1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER_CHARS, UPPER_CHARS.lower())


def staged_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def arrow_batch(columns: dict, schema: T.StructType) -> pa.RecordBatch:
    """A record batch of Python lists or arrays, typed as the Spark schema says."""
    arrays = []
    for field in schema.fields:
        data, kind = columns[field.name], arrow_type(field.dataType)
        arrays.append(data.cast(kind) if isinstance(data, (pa.Array, pa.ChunkedArray)) else pa.array(data, type=kind))
    return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet, whatever the case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def schema_of(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)
