"""A filter of bounded size that says which rows may have a partner, so that only these are shuffled for a join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS_A_KEY = 10
MOST_CELLS = 1 << 30
PROBES = 3


def maybe_in(spark: SparkSession, column: str, keys: DataFrame) -> Column:
    """Whether the value of column may be in keys' column of that name; true for all that are.

    A Bloom filter: PROBES bits a key, among CELLS_A_KEY cells for each row of
    keys, so under 2 % of other values pass.  It has at most MOST_CELLS cells,
    128 MB in each Python worker, enough for 10^8 keys, which reach the driver as
    at most MOST_CELLS / 64 rows.  With more keys it lets more rows through,
    which costs time but loses nothing.  keys are read twice.
    """
    cells = min(MOST_CELLS, 64 * (16 + keys.count() * CELLS_A_KEY // 64))
    at = [F.pmod(F.xxhash64(column, F.lit(i)), F.lit(cells)) for i in range(PROBES)]
    set_bit = F.expr("shiftleft(1L, CAST(cell & 63 AS INT))")
    held = keys.select(F.explode(F.array(*at)).alias("cell")).groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(set_bit).alias("bits")).toArrow()
    bits = np.zeros(cells // 64, np.int64)
    bits[held.column(0).to_numpy()] = held.column(1).to_numpy()
    shared = spark.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def marked(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        out = np.ones(len(a), bool)
        for cell in (x.to_numpy() for x in (a, b, c)):
            out &= (shared.value[cell >> 6] >> (cell & 63) & 1).astype(bool)
        return pa.array(out)

    return marked(*at)
