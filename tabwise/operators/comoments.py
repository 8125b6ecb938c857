"""Sums of products over complete pairs of many columns in one scan, and the correlations they give.

Every task adds up one mergeable matrix for its rows: counts, sums, squares and products of all pairs,
with null masks.  The scan does not grow with the number of pairs; only K x K numbers a task are moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabwise.functions.exprs import q
from tabwise.session import ship

#: Rows of one matrix product.
BLOCK = 8_192


def _numbers(batch: pa.RecordBatch, at: int) -> np.ndarray:
    """Rows of a block as doubles, nulls as NaN."""
    part = batch.slice(at, BLOCK)
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns])


def co_moments(num: DataFrame) -> DataFrame:
    """(i, j, n, si, sj, sii, sjj, sij) of every pair i < j of the double columns, over rows where both are filled.

    Values are taken relative to a value of their column, so that large means cost no digits.
    """
    num = num.toDF(*[f"c{i}" for i in range(len(num.columns))])
    k = len(num.columns)
    shift = [v or 0.0 for v in num.agg(*[F.avg(q(c)) for c in num.columns]).first()]
    shift = np.array([v if np.isfinite(v) else 0.0 for v in shift])
    i, j = np.triu_indices(k, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss, p = (np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                z = _numbers(batch, at) - shift
                m = ~np.isnan(z)
                z[~m] = 0.0
                f = m.astype(float)
                n += f.T @ f
                s += z.T @ f
                ss += (z * z).T @ f
                p += z.T @ z
        own = np.flatnonzero(n[i, j])
        for at in range(0, len(own), 100_000):
            a, b = i[own[at:at + 100_000]], j[own[at:at + 100_000]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a.astype(np.int32), b.astype(np.int32), n[a, b], s[a, b], s[b, a], ss[a, b], ss[b, a], p[a, b])], names)

    names = ["i", "j", "n", "si", "sj", "sii", "sjj", "sij"]
    ship(num.sparkSession)
    parts = num.mapInArrow(run, "i int, j int, " + ", ".join(f"{c} double" for c in names[2:]))
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names[2:]])


def correlations(num: DataFrame) -> DataFrame:
    """(i, j, r) of every pair i < j; NULL where a side has no variance over the pair's rows."""
    mean = "(sij - si * sj / n)"
    spread = "sqrt(greatest(sii - si * si / n, 0D)) * sqrt(greatest(sjj - sj * sj / n, 0D))"
    # rounding leaves a trace of variance where there is none
    flat = "sii - si * si / n <= 1e-14 * sii or sjj - sj * sj / n <= 1e-14 * sjj"
    return co_moments(num).select("i", "j", F.expr(f"case when not ({flat}) then greatest(-1D, least(1D, try_divide({mean}, nullif({spread}, 0D)))) end").alias("r"))
