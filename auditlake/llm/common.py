"""Small things the operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, batches: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``mapInArrow`` with a function from record batches to dicts of columns."""
    typed = to_arrow_schema(StructType.fromDDL(schema))

    def run(source):
        for columns in batches(source):
            yield pa.RecordBatch.from_pydict({n: columns[n] for n in typed.names}, schema=typed)

    return df.mapInArrow(run, schema)


def slices(batches: Iterator, rows: int = 1024) -> Iterator:
    """The batches in slices, so that what Python holds of one at a time stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def words_of(text: str | None) -> list[bytes]:
    """The words as UTF-8 bytes; bytes.split() splits on exactly the white space of ``WORD``."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hex_long(digest: F.Column, digits: int) -> F.Column:
    """The first hex digits of a digest as a long; 15 digits at most."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")
