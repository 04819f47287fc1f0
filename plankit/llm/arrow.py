"""Running Python over Arrow batches on executors that may not have this package."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plankit.llm.tokens import encoder

_ROOT = Path(__file__).resolve().parent.parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once for an application, unless PYTHONPATH names it already."""
    context = spark.sparkContext
    named = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if context.applicationId in _shipped or _ROOT in named:
        return
    path = Path(tempfile.mkdtemp(prefix="plankit-source-")) / "plankit.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted((_ROOT / "plankit").rglob("*.py")):
            archive.write(file, file.relative_to(_ROOT))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def give_back() -> None:
    """Return memory that is free, but that Arrow or the C library holds, to the system: a driver or a worker lives on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def lean(each: Callable, encodes: bool = False) -> Callable:
    """each, for workers that run several operators in turn: a task forgets the encoders of those before, unless it encodes, and gives its memory back at the end.

    A worker that waits would else keep, beside those that run, what its last task took.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encodes:
            encoder.cache_clear()
        try:
            yield from each(batches)
        finally:
            give_back()

    return task


def map_arrow(df: DataFrame, each: Callable, schema) -> DataFrame:
    """df.mapInArrow() with the package shipped."""
    ship(df.sparkSession)
    return df.mapInArrow(each, schema)
