"""Whitening of embeddings by distributed block matrices."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import materialise, new_path

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
#: Entries of this size or more count as non-finite: their squares would not fit the exact sums.
LARGEST = float(1 << 40)
#: Bytes of one block of centred rows.
BLOCK_BYTES = 1 << 20
#: Blocks that meet in one partial product of the scatter.
MEETING = 32
#: Components whose variance is below this share of the largest are not whitened: they are rounding.
RANK_SHARE = 1e-11

_MATRIX = MatrixUDT.sqlType()
_MATRIX_ARROW = pa.struct([("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())), ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_())])
#: Written blocks: number of the task, of the block in it, and what the rows carry along.
BLOCKS = T.StructType([
    T.StructField("part", T.LongType()), T.StructField("nth", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())),
    T.StructField("deviation", T.ArrayType(T.DecimalType(38, 0))), T.StructField("matrix", _MATRIX),
])
_RESULT = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<bigint>) of the vectors without NULL or non-finite entries."""
    entry = lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False))  # noqa: E731  NaN counts as the largest value
    x = F.transform("embedding", lambda c: F.floor(F.when(entry(c), c.cast("double") * SCALE)) + OFFSET)
    return vectors.where(F.col("embedding").isNotNull() & F.forall("embedding", entry)).select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(size).tolist():
        yield dim, np.flatnonzero(size == dim)


def totals(x: DataFrame) -> tuple[int, int, list[int]]:
    """(dimension, n, sums): the length that most vectors have (of equals the largest), how many, and their sums."""

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in it:
            column = batch.column(0)
            for dim, rows in _by_length(column):
                if dim:
                    sums[dim] = sums.get(dim, 0) + _matrix(column.take(pa.array(rows)), dim).sum(axis=0)
                    count[dim] = count.get(dim, 0) + len(rows)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.int32()), pa.array(list(count.values()), pa.int64()), pa.array([sums[d].tolist() for d in count], pa.list_(pa.int64()))], ["dim", "n", "sums"])

    parts = materialise(x.select("x").mapInArrow(run, "dim int, n bigint, sums array<bigint>"), "sums")
    most = parts.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if most is None:
        return 0, 0, []
    rows = parts.where(F.col("dim") == most.dim).select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    return most.dim, most.n, [int(r.v) for r in sorted(rows, key=lambda r: r["at"])]


def deviations(y: np.ndarray, rest: list[int], n: int) -> list[Decimal | None]:
    """Sum of (n*y - rest)^2 of each row, exact; None beyond 38 digits."""
    top, far = int(np.abs(y).max(initial=0)), max(map(abs, rest), default=0)
    if len(rest) * top * max(top, far) < 1 << 62:
        square, cross = (y * y).sum(axis=1).tolist(), (y @ np.array(rest, np.int64)).tolist()
    else:
        whole = y.astype(object)
        square, cross = (whole * whole).sum(axis=1).tolist(), whole.dot(np.array(rest, object)).tolist()
    own = sum(r * r for r in rest)
    exact = (n * n * s - 2 * n * c + own for s, c in zip(square, cross))
    return [Decimal(v) if v < 10**38 else None for v in exact]


def centred_blocks(x: DataFrame, dim: int, n: int, sums: list[int]) -> str:
    """Path of written blocks of centred rows with their ids, numbered within each task.

    Each task packs its rows as they come: no row is exchanged.  The last block
    of a task is shorter, which block products allow.  Entries are centred as
    whole numbers first, so that the large offset costs no digits.
    """
    near = [round(s / n) for s in sums]  # whole numbers near the means
    rest = [s - n * k for s, k in zip(sums, near)]
    high = max(1, BLOCK_BYTES // (8 * dim))

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        shift, mean = np.array(near, np.int64), np.array([r / n for r in rest])
        ids: list = []
        held: list[np.ndarray] = []

        def pack(most: int) -> Iterator[pa.RecordBatch]:
            nonlocal ids, held, nth
            if not ids:
                return
            y = np.concatenate(held)
            at = 0
            while len(ids) - at >= most or at < len(ids) and most == 1:
                block = y[at:at + high]
                matrix = {"type": 1, "numRows": len(block), "numCols": dim, "values": (block - mean).ravel(), "isTransposed": True}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int64()), pa.array([nth], pa.int64()), pa.array([ids[at:at + high]], pa.list_(pa.int64())),
                     pa.array([deviations(block, rest, n)], pa.list_(pa.decimal128(38, 0))), pa.array([matrix], _MATRIX_ARROW)], ["part", "nth", "ids", "deviation", "matrix"]
                )
                nth += 1
                at += high
            ids, held = ids[at:], [y[at:]]

        for batch in it:
            for length, rows in _by_length(batch.column(1)):
                if length == dim:
                    own = batch.take(pa.array(rows))
                    ids.extend(own.column(0).to_pylist())
                    held.append(_matrix(own.column(1), dim) - shift)
            yield from pack(high)
        yield from pack(1)

    path = new_path(x.sparkSession, "centred-blocks")
    x.select("vec_id", "x").mapInArrow(run, BLOCKS).write.parquet(path)
    return path


def block_matrix(spark: SparkSession, path: str, row: Column, column: Column, shape: tuple[int, int], block: tuple[int, int]) -> BlockMatrix:
    """A block matrix over written blocks; read as matrices there, they never leave the JVM."""
    kind = T.StructType([T.StructField(f.name, MatrixUDT() if f.name == "matrix" else f.dataType) for f in BLOCKS])
    keyed = spark.read.schema(kind).parquet(path).select(F.struct(row.cast("bigint"), column.cast("bigint")), "matrix")
    return BlockMatrix(callMLlibFunc("createBlockMatrix", keyed, *block, *shape), *block)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each vector and leading component.

    Entries c become floor(SCALE * c) + OFFSET.  Left out are vectors that are
    NULL, empty, hold a NULL or non-finite entry or one of 2^40 or more, or have
    another length than most.  ``deviation`` is NULL beyond 38 digits.
    Components without variance (fewer vectors than components, equal vectors)
    are left out: nothing can be scaled to unit variance there.  Repeated rows and
    ids count each, rows without vec_id too; other columns are ignored; of equal
    eigenvalues any basis may come out.  The sign of a component makes its
    largest entry positive.
    """
    spark = vectors.sparkSession
    x = scaled(vectors)
    dim, n, sums = totals(x)
    if not n:
        return spark.createDataFrame([], _RESULT)
    path = centred_blocks(x, dim, n, sums)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    last = blocks.agg(F.max("part").alias("part"), F.max("nth").alias("nth")).first()
    number, numbers = F.col("part") * (last.nth + 1) + F.col("nth"), (last.part + 1) * (last.nth + 1)
    high = max(1, BLOCK_BYTES // (8 * dim))

    # Scatter: the inner dimension is split, so partial products are spread and added up on the way.
    tall = block_matrix(spark, path, number, F.lit(0), (numbers * high, dim), (high, dim))
    splits = max(1, min(numbers, max(spark.sparkContext.defaultParallelism, -(-numbers // MEETING))))
    product = tall.transpose()._java_matrix_wrapper.call("multiply", tall._java_matrix_wrapper._java_model, splits)
    scatter = BlockMatrix(product, dim, dim).toLocalMatrix().toArray() / n
    value, vector = np.linalg.eigh((scatter + scatter.T) / 2)
    value, vector = value[::-1], vector[:, ::-1]
    trace = float(np.trace(scatter))
    k = int(min(components, np.sum(value > RANK_SHARE * max(value[0], 0.0)) if value[0] > 0 else 0))
    if not k:
        return spark.createDataFrame([], _RESULT)
    vector = vector[:, :k] * np.sign(vector[np.abs(vector[:, :k]).argmax(axis=0), np.arange(k)])
    project = vector / np.sqrt(value[:k])

    # Projection: a tall product would fall into few tasks, so the blocks are folded over a square
    # grid and multiplied with a diagonal of whitening matrices; each block meets one of them.
    fold = max(1, math.isqrt(max(1, min(numbers, blocks.rdd.getNumPartitions()))))
    square = block_matrix(spark, path, F.floor(number / fold), number % fold, (-(-numbers // fold) * high, fold * dim), (high, dim))
    cell = DenseMatrix(dim, k, project.T.ravel().tolist())
    diagonal = BlockMatrix(spark.sparkContext.parallelize([((g, g), cell) for g in range(fold)], fold), dim, k, fold * dim, fold * k)
    done = callMLlibFunc("getMatrixBlocks", square.multiply(diagonal)._java_matrix_wrapper._java_model).toDF("at", "matrix")
    target = new_path(spark, "whitened-blocks")
    done.write.parquet(target)
    spot = T.StructType([T.StructField("_1", T.IntegerType()), T.StructField("_2", T.IntegerType())])
    read = spark.read.schema(T.StructType([T.StructField("at", spot), T.StructField("matrix", _MATRIX)])).parquet(target)
    m = F.col("matrix")
    cells = read.select((F.col("at._1").cast("bigint") * fold + F.col("at._2")).alias("block"), m["values"].alias("v"), m["numRows"].alias("high"), m["isTransposed"].alias("by_row"))

    def entry(row: Column, c: Column | int) -> Column:
        return F.get("v", F.when(F.col("by_row"), row * k + c).otherwise(F.col("high") * c + row))

    flat = cells.select(*[c for c in cells.columns], F.explode(F.sequence(F.lit(0), F.col("high") - 1)).alias("row")).select(*[entry(F.col("row"), c).alias(f"w{c}") for c in range(k)])
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    covariance = flat.agg(*[F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs]).first()
    error = max(abs(covariance[f"c{a}_{b}"] - (a == b)) for a, b in pairs)

    named = cells.join(blocks.select(number.alias("block"), "ids", "deviation"), "block")
    rows = named.select("v", "high", "by_row", F.posexplode(F.arrays_zip("ids", "deviation")).alias("row", "own"))
    share = F.array(*[F.lit(float(e / trace)) for e in value[:k]])
    long = rows.select("v", "high", "by_row", "row", "own", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("c"))
    return long.select(
        F.col("own.ids").alias("vec_id"), (F.col("c") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), F.col("own.deviation").alias("deviation"),
        entry(F.col("row"), F.col("c")).alias("whitened"), F.get(share, F.col("c")).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
