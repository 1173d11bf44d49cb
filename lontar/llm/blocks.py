"""A stated query set against all rows, block by block."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of vectors that a block of candidates or of queries has at most.  Every candidate is sent once for each block
#: of queries, so blocks are as large as a worker's memory allows: n rows are sent n / (100 x rows of a block) times.
BLOCK_BYTES = 1 << 24
#: Blocks of candidates that small tables still get, for the executors to share, and rows of a block at least.
LEAST_BLOCKS, LEAST_ROWS = 24, 512


def usable(id_col: str, vector_col: str) -> Column:
    """Rows that take part: an id, and a vector without null or non-finite components."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False))


def scan_blocks(vectors: DataFrame, is_query: Column, scan: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Run `scan(queries, candidates)` on every pair of a query block and a candidate block.

    `vectors` has vec_id and vector, an array or a struct whose first field is
    one.  Both sides are dealt to blocks of bounded size by hash; a block of one
    side is sent once to every block of the other, so a task holds two blocks,
    whatever the tables' sizes.  A query row that stands more than once is asked
    once; as a candidate each row counts.
    """
    kind = vectors.schema["vector"].dataType
    components = F.size(f"vector.{kind.names[0]}" if isinstance(kind, T.StructType) else "vector")
    n, q, size = vectors.agg(F.count(F.lit(1)), F.count_if(is_query), F.max(components)).first()
    most = max(1, BLOCK_BYTES // (8 * (size or 1)))
    per_block = min(most, max(LEAST_ROWS, -(-n // LEAST_BLOCKS)))
    rows, queries = max(1, -(-n // per_block)), max(1, -(-q // most))
    # Rows with equal ids and vectors are told apart by where they were read.
    deal = F.xxhash64("vec_id", F.monotonically_increasing_id())
    number = T.StructField("block", T.IntegerType())
    candidates = vectors.select("vec_id", "vector", F.pmod(deal, F.lit(rows)).cast(number.dataType).alias("row_block")).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(queries - 1))))
    once = vectors.where(is_query).select("vec_id", "vector").distinct()
    asked = once.select("vec_id", "vector", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(queries)).cast(number.dataType).alias("query_block")).withColumn("row_block", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    keys = ["row_block", "query_block"]
    return asked.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(scan, schema)
