"""Helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from clienttrace.session import written

__all__ = ["columns", "fold", "keep_texts", "map_texts", "raw", "written"]

def fold(id_column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def raw(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case; null is empty. ``split()`` of it cuts at blanks and 09-0D only."""
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns; whatever else a table carries, under any name, stays behind."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def map_texts(docs: DataFrame, id_column: str, text_column: str, out: dict[str, pa.DataType],
              fn: Callable[[list[str | None]], Iterable[list]]) -> DataFrame:
    """The ids of all rows, unchanged, with the columns ``fn`` makes of a batch of whole texts."""
    def run(batches):
        for batch in batches:
            made = fn(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(m, t) for m, t in zip(made, out.values()))], ["id", *out])

    rows = columns(docs, id_column, text_column).toDF("id", "text")
    schema = ", ".join([f"id {rows.schema['id'].dataType.simpleString()}", *(f"{n} {from_arrow_type(t).simpleString()}" for n, t in out.items())])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def keep_texts(docs: DataFrame, text_column: str, keep: Callable[[str | None], bool]) -> DataFrame:
    """The rows of ``docs``, in all columns, whose text ``keep`` accepts."""
    at = docs.columns.index(text_column)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([keep(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
