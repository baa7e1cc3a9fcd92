"""Embedding whitening with MLlib's BlockMatrix.

Vectors become integers, which keep every sum and product exact. A first pass indexes them into blocks of rows and
writes those once; all later passes read blocks. The rows are centred at the integer next to each dimension's mean, a
BlockMatrix A is made of them, and A'A gives the scatter: products of integers, exact up to 2**53. What is left of the
mean, half a unit at most, leaves the scatter by its rank-one term. A local `eigh` of the d x d covariance yields the
components, and A times the whitening matrix projects the rows. What reaches the driver is bounded by the dimension:
sums, the scatter, and the row and column number of each block (one of BLOCK_BYTES).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from juryframe.llm.common import cut, prepare

#: Bytes of one block of rows as doubles.
BLOCK_BYTES = 2 << 20
#: Blocks whose products one task adds up.
BLOCKS_A_TASK = 8
#: An entry beyond this has no exact integer and counts as not finite.
LARGEST = float(1 << 53)
#: Eigenvalues below this share of the largest are rounding of zero.
ZERO = 1e-12

_BLOCK = pa.schema([("part", pa.int32()), ("k", pa.int32()), ("size", pa.int32()), ("ids", pa.list_(pa.int64())),
                    ("values", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64()))])
_MATRIX = ["type", "numRows", "numCols", "colPtrs", "rowIndices", "values", "isTransposed"]


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: its size, sums per dimension, eigenvalues by falling size and unit eigenvectors (columns)."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def base(self) -> np.ndarray:
        """The integer next to each mean."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """n times what the mean has beyond `base`; exact."""
        return np.array([s - self.n * int(b) for s, b in zip(self.sums, self.base)], np.int64)

    @property
    def matrix(self) -> np.ndarray:
        """d x components: rows times this are white. A component without spread has zeros."""
        spread = self.eigenvalues > ZERO * max(self.eigenvalues.max(initial=0), 0)
        return np.where(spread, self.vectors / np.sqrt(np.where(spread, self.eigenvalues, 1)), 0)


def integers(vector: Column, scale: int = 1024, shift: int = 100_000) -> Column:
    """floor(scale * c) + shift of each entry c; null for a vector that is null, or holds a null or an entry that isn't finite."""
    scaled = F.transform(vector, lambda c: c.cast("double") * F.lit(float(scale)))
    usable = F.forall(scaled, lambda c: F.coalesce(F.abs(c) <= F.lit(LARGEST), F.lit(False)) & ~F.isnan(c))
    return F.when(usable, F.transform(scaled, lambda c: F.floor(c).cast("long") + F.lit(shift)))


def blocks(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024, shift: int = 100_000,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows in blocks, written once: part and k (which block), size (dimension), ids, values (row after row), sums per dimension.

    Null vectors, empty ones, and vectors with nulls or entries that aren't finite (or beyond 2**53 once scaled) are left
    out. Of several dimensions the most frequent one is kept, the larger of two equally frequent. Ids may be null or
    repeated; each row stays a row of its own.
    """

    def run(source):
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list, list]] = {}

        def block(size: int):
            nonlocal count
            ids, rows = held.pop(size)
            values = np.array(rows, np.int64)
            columns = [[part], [count], [size], [ids], [values.ravel()], [values.sum(0)]]
            count += 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCK)], schema=_BLOCK)

        for batch in source:
            sizes = np.diff(np.asarray(batch.column(1).offsets))
            flat, at = np.asarray(batch.column(1).flatten()), 0
            for key, size in zip(batch.column(0).to_pylist(), sizes.tolist()):
                ids, rows = held.setdefault(size, ([], []))
                ids.append(key)
                rows.append(flat[at:at + size])
                at += size
                if len(ids) * size * 8 >= block_bytes:
                    yield block(size)
        for size in list(held):
            yield block(size)

    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), integers(F.col(vector), scale, shift).alias("x")).where(F.size("x") > 0)
    prepare(vectors.sparkSession)
    made = cut(rows.mapInArrow(run, "part int, k int, size int, ids array<long>, values array<long>, sums array<long>"))
    most = made.groupBy("size").agg(F.sum(F.size("ids")).alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1)
    return made.join(F.broadcast(most.select("size")), "size")  # one row


def numbered(made: DataFrame) -> DataFrame:
    """The blocks with a dense number `block`: blocks of earlier parts first. One row a part is ordered in one task."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = made.groupBy("part").agg((F.max("k") + 1).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return made.join(first, "part").withColumn("block", F.col("first") + F.col("k")).drop("first")


def _matrices(base: np.ndarray, height: int) -> Callable:
    """Blocks as MLlib matrices of `height` rows: values less `base`; a shorter block is filled up with zero rows, which add nothing."""

    def run(source):
        for batch in source:
            for block, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.asarray(values.values).reshape(-1, len(base)) - base
                full = np.zeros((height, len(base)))
                full[:len(x)] = x
                fields = [pa.array([1], pa.int8()), pa.array([height], pa.int32()), pa.array([len(base)], pa.int32()), pa.nulls(1, pa.list_(pa.int32())),
                          pa.nulls(1, pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array([0, full.size], pa.int32()), pa.array(full.ravel())), pa.array([True])]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.StructArray.from_arrays(fields, _MATRIX)], ["block", "m"])

    return run


def block_matrix(made: DataFrame, base: np.ndarray, height: int, count: int) -> BlockMatrix:
    """The centred rows of all blocks as one BlockMatrix."""
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("m", MatrixUDT())])
    rows = made.select("block", "values").mapInArrow(_matrices(base, height), schema)
    at = F.struct(F.col("block").alias("_1"), F.lit(0).cast("long").alias("_2"))
    java = callMLlibFunc("createBlockMatrix", rows.select(at.alias("at"), "m"), height, len(base), height * count, len(base))
    return BlockMatrix(java, height, len(base))


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """A'A. The long middle dimension is split, so each task adds the products of BLOCKS_A_TASK blocks."""
    left, right = matrix.transpose()._java_matrix_wrapper._java_model, matrix._java_matrix_wrapper._java_model
    splits = max(1, -(-int(matrix.numRowBlocks) // BLOCKS_A_TASK))
    product = BlockMatrix(left.multiply(right, splits), matrix.colsPerBlock, matrix.colsPerBlock)  # Python's multiply has no splits
    return product.toLocalMatrix().toArray()


@dataclass(frozen=True)
class Fitted:
    """The written blocks with their numbers, their BlockMatrix and the whitening learned from them."""

    blocks: DataFrame
    matrix: BlockMatrix
    whitening: Whitening


def fit(vectors: DataFrame, *, components: int = 8, **how) -> Fitted | None:
    """Learn the whitening of all usable vectors; None if there are none. `how` goes to `blocks`."""
    made = blocks(vectors, **how)
    sums = made.select(F.posexplode("sums").alias("pos", "s")).groupBy("pos").agg(F.sum("s").alias("s")).orderBy("pos").collect()
    if not sums:
        return None
    n, height, count = made.agg(F.sum(F.size("ids")), F.max(F.size("ids")), F.count("*")).first()
    # the learned values follow once the scatter is known; base and rest need the sums alone
    plain = Whitening(n, [r["s"] for r in sums], np.zeros(0), np.zeros((len(sums), 0)), 0.0)
    rows = numbered(made)
    matrix = block_matrix(rows, plain.base, height, count)
    rest = plain.rest / n
    covariance = (scatter(matrix) - n * np.outer(rest, rest)) / n
    values, vectors_ = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    return Fitted(rows, matrix, Whitening(n, plain.sums, values[order], vectors_[:, order], float(np.trace(covariance))))


def _marks(base: np.ndarray, rest: np.ndarray):
    """Per block: ids, and of each row the sum of squares less `base` and its product with `rest`; exact integers."""
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("squares", pa.list_(pa.int64())), ("crossed", pa.list_(pa.int64()))])

    def run(source):
        for batch in source:
            for block, ids, values in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                y = np.asarray(values.values).reshape(-1, len(base)) - base
                columns = [[block], [ids.as_py()], [(y * y).sum(1)], [y @ rest]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run, "block long, ids array<long>, squares array<long>, crossed array<long>"


def _projected(off: np.ndarray):
    """Blocks of the product as one list of rows each, less the projection of the mean's rest."""
    schema = pa.schema([("block", pa.int64()), ("white", pa.list_(pa.list_(pa.float64())))])

    def run(source):
        for batch in source:
            at, matrices = batch.column(0).field(0).to_pylist(), batch.column(1)
            for i, block in enumerate(at):
                m = matrices[i]
                shape = m["numRows"].as_py(), m["numCols"].as_py()
                values = np.asarray(m["values"].values)
                rows = values.reshape(shape) if m["isTransposed"].as_py() else values.reshape(shape[::-1]).T
                rows = np.ascontiguousarray(rows - off)
                inner = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, shape[1]), pa.int32()), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner)], schema=schema)

    return run, "block long, white array<array<double>>"


def project(fitted: Fitted) -> DataFrame:
    """id, deviation (decimal: sum over dimensions of (n * x - sum)^2), white (one double per component), for each row of the blocks."""
    w = fitted.whitening
    spark, d, k = fitted.blocks.sparkSession, len(w.sums), w.matrix.shape[1]
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(d, k, w.matrix.ravel(order="F").tolist()))], 1), d, k, d, k)
    product = callMLlibFunc("getMatrixBlocks", fitted.matrix.multiply(right)._java_matrix_wrapper._java_model)
    white = product.toDF("at", "m").mapInArrow(*_projected(w.rest / w.n @ w.matrix))
    marks = fitted.blocks.select("block", "ids", "values").mapInArrow(*_marks(w.base, w.rest))
    # rows that only fill up a block have no id and go with the shorter list
    rows = marks.join(white, "block").select(F.explode(F.arrays_zip("ids", "squares", "crossed", F.slice("white", 1, F.size("ids")).alias("white"))).alias("r")).select("r.*")
    exact = lambda v: F.lit(Decimal(v)).cast("decimal(38,0)")
    deviation = exact(w.n * w.n) * F.col("squares").cast("decimal(20,0)") - exact(2 * w.n) * F.col("crossed").cast("decimal(20,0)") + exact(sum(int(t) ** 2 for t in w.rest))
    return rows.select(F.col("ids").alias("id"), deviation.cast("decimal(38,0)").alias("deviation"), "white")


def identity_error(rows: DataFrame, w: Whitening) -> float | None:
    """Largest absolute entry of the covariance of `white` less the identity, over components with spread; None if there are none."""
    live = np.flatnonzero(np.abs(w.matrix).sum(0) > 0).tolist()
    if not live:
        return None
    terms = [F.abs(F.covar_pop(F.col("white")[i], F.col("white")[j]) - F.lit(float(i == j))) for i, j in combinations_with_replacement(live, 2)]
    return rows.agg(F.greatest(*terms) if len(terms) > 1 else terms[0]).first()[0]


def whiten(vectors: DataFrame, *, components: int = 8, **how) -> DataFrame:
    """One row per usable vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows are those of `blocks`. A component without spread (vectors in fewer dimensions, or all alike) has a null
    `whitened`; where nothing has any spread, `explained` is null too. No usable vector gives no row. Columns beside the
    two named are ignored.
    """
    schema = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    fitted = fit(vectors, components=components, **how)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema)
    w = fitted.whitening
    rows = cut(project(fitted))
    live = np.abs(w.matrix).sum(0) > 0
    table = F.array(*[F.struct(F.lit(i + 1).alias("component"), (F.col("white")[i] if live[i] else F.lit(None).cast("double")).alias("whitened"),
                               F.lit(float(e / w.trace) if w.trace > 0 else None).cast("double").alias("explained")) for i, e in enumerate(w.eigenvalues)])
    error = F.lit(identity_error(rows, w)).cast("double").alias("identity_error")
    flat = rows.select("id", "deviation", F.explode(table).alias("c"))
    return flat.select("id", "c.component", F.lit(w.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", error)
