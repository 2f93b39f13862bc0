"""Rolling windows of a series in time blocks: a row travels to the few blocks whose windows hold it.

A window per row would shuffle window x panel values.  Here a task gets a stretch
of ``block`` ends with the rows before it that their windows reach back to, so
what is exchanged is the panel, once or a few times, whatever the step.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskloom.session import spread

BLOCK = 512


def _column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow column; masked values are NULL."""
    mask = np.ma.getmaskarray(values) if isinstance(values, np.ma.MaskedArray) else None
    return pa.array(np.asarray(values), mask=mask).cast(kind)


def each_block(rets: DataFrame, window: int, compute: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str, block: int = BLOCK, key: str = "asset") -> DataFrame:
    """(key, date, ...) for every row with a whole window behind it, the row itself included.

    ``compute`` takes the windows of consecutive ends as an (ends x window) view
    and returns columns with one value per end, or an ``end`` column of positions
    beside columns of any length.  ``schema`` lists those columns.  Rows without a
    value are left out first; a key has one row per date.  Blocks are spread over
    all tasks: they are few bytes, but their windows are work.
    """
    order = Window.partitionBy(key).orderBy("date")
    rows = rets.where(F.col("r").isNotNull()).select(key, "date", "r").withColumn("at", F.row_number().over(order) - 1)
    blocks = F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + window - 1) / block))
    parts = rows.select(key, "date", "r", "at", F.explode(blocks).alias("block"))
    kind = T.StructType([rets.schema[key], rets.schema["date"], *[f for f in T._parse_datatype_string(schema)]])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        start = table["block"][0].as_py() * block
        at, r = table["at"].to_numpy(), table["r"].to_numpy()
        first = max(int(at[0]) + window - 1, start)
        ends = np.arange(first, int(at[-1]) + 1)
        ends = ends[ends < start + block]
        fields = [table.schema.field(f.name) if f.name in (key, "date") else f for f in to_arrow_schema(kind)]
        if not len(ends):
            return pa.schema(fields).empty_table()
        view = np.lib.stride_tricks.sliding_window_view(r, window)[ends[0] - window + 1 - int(at[0]):][: len(ends)]
        out = compute(view)
        which = out.pop("end", np.arange(len(ends)))
        place = pa.array(ends[which] - int(at[0]))
        cols = [table[key].take(place), table["date"].take(place), *(_column(out[f.name], f.type) for f in fields[2:])]
        return pa.table(cols, schema=pa.schema(fields))

    return spread(parts, key, "block").groupBy(key, "block").applyInArrow(run, kind)

