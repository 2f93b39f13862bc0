"""Byte-level words and batch iteration shared by the text operators.

Words are runs of bytes other than ASCII white space.  ``bytes.lower`` changes
A-Z only and ``bytes.split`` splits on ``\\x20 \\x09-\\x0D`` only, which is the
definition the contracts use; UTF-8 continuation bytes are never touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

BLOCK_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


#: Bytes of an Arrow batch of texts sent to a Python task.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, so that a task holds few texts at once; a smaller setting of the session stays."""
    now = spark.conf.get(_BATCH_CONF, None)
    digits = re.fullmatch(r"(\d+)b?", now or "")
    if digits is None or int(digits[1]) > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def word_blocks(raw: bytes, block: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Words of ``raw`` in lists of about ``block`` bytes, so a huge text never becomes one list."""
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + block)
        if end < n:
            found = _SPACE.search(raw, end)
            end = found.start() if found else n
        words = raw[at:end].split()
        if words:
            yield words
        at = end


def batches(it: Iterable, *columns: str) -> Iterator[tuple[list, ...]]:
    """Python lists of the named columns for each Arrow batch."""
    for batch in it:
        yield tuple(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns)
