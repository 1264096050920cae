"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import clear, cut, fresh_path, marked, shared_dir, ship_package, stored

#: A fresh folder in the shared one, which clear() removes.
scratch = fresh_path

#: Characters that separate words: space, and tab to carriage return.
SPACE = r"[ \t\n\x0B\f\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each led by as many underscores as keep it apart from the columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


_SPACE_BYTE = re.compile(rb"[ \t-\r]")


def parts_of(data: bytes, step: int) -> Iterator[bytes]:
    """``data`` in parts of about ``step`` bytes, cut at white space."""
    at = 0
    while at < len(data):
        end = _SPACE_BYTE.search(data, at + step) if len(data) - at > step else None
        end = end.start() if end else len(data)
        yield data[at:end]
        at = end


def tidy(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A step of mapInArrow() that hands back the memory it no longer needs when it ends:
    Spark keeps the worker, and what its allocators keep would stand beside the next step's."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from step(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library alone
            if trim:
                trim(0)

    return run


def id_crc32(doc_id: Column) -> Column:
    """crc32 of the id written as text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


__all__ = [
    "SPACE", "clear", "cut", "id_crc32", "marked", "parts_of", "scratch", "shared_dir", "ship_package", "stored", "table", "text_or_empty", "tidy", "unused",
]
