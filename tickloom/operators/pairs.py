"""Moments and correlations of all pairs of series, block of series by block of series.

Series are dealt to blocks and times to chunks, both by hash.  A series' values of a
chunk are packed into one row, which goes once to each pair of blocks that its own
block is in; there one product of matrices gives the sums of all pairs of the chunk.
So what is shuffled grows with the rows and the number of blocks, and with the pairs
by chunk, never with pairs by time.  A task holds two blocks of one chunk.

Defined results: values meet at equal times, each with each where a series has
several at a time, as a self-join would have it; rows whose symbol, time or value is
null, NaN or infinite meet nothing; a correlation is null where a side does not vary
at the times that both have.  Columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Series of a block, and times of a chunk, on average.
PER_BLOCK = 256
PER_CHUNK = 2048

#: Sums over the times of a pair: how many, of either side, of their squares, and of the product.
SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")
#: Share of the sum of squares below which a variance is rounding.
_FLAT = 1e-12


def _number(rows: DataFrame) -> Column:
    """``ts`` as a whole number, whatever its type and the session's zone."""
    kind = dict(rows.dtypes)["ts"]
    if kind == "timestamp":
        return F.unix_micros("ts")
    if kind in ("date", "timestamp_ntz"):
        return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', CAST(ts AS timestamp_ntz))")
    return F.col("ts").cast("long")


def packed(rows: DataFrame, value: str, flag: str | None = None, per_block: int = PER_BLOCK, per_chunk: int = PER_CHUNK) -> tuple[DataFrame, int]:
    """One row a symbol and chunk (symbol, block, chunk, at: its times, their count, sum and sum of squares), and the number of blocks.

    Values are taken from the symbol's mean, which changes no correlation and keeps the sums exact.
    """
    finite = F.col("__x").isNotNull() & ~F.isnan("__x") & (F.abs("__x") < float("inf"))
    marked = F.coalesce(F.col(flag).cast("boolean"), F.lit(False)) if flag else F.lit(True)
    x = rows.select("symbol", "ts", F.col(value).cast("double").alias("__x"), marked.alias("__f")).filter(finite & F.col("symbol").isNotNull() & F.col("ts").isNotNull())
    symbols, times = x.agg(F.approx_count_distinct("symbol"), F.approx_count_distinct("ts")).first()
    blocks, chunks = -(-symbols // per_block) or 1, -(-times // per_chunk) or 1
    x = x.join(x.groupBy("symbol").agg(F.avg("__x").alias("__m")), "symbol").withColumn("__x", F.col("__x") - F.col("__m"))

    def sums(of: Column, k: str) -> list[Column]:
        return [F.sum(of.cast("double")).alias(f"n{k}"), F.sum(F.when(of, F.col("__x"))).alias(f"s{k}"), F.sum(F.when(of, F.col("__x") * F.col("__x"))).alias(f"q{k}")]

    kinds = [(F.lit(True), ""), *([(F.col("__f"), "f")] if flag else [])]
    each = x.groupBy("symbol", "ts").agg(*[c for of, k in kinds for c in sums(of, k)]).fillna(0.0)
    chunk = F.pmod(F.xxhash64("ts"), F.lit(chunks)).alias("chunk")
    fields = [c for c in each.columns if c not in ("symbol", "ts")]
    at = [F.collect_list(F.struct(_number(rows).alias("t"), *fields)).alias("at")]
    out = each.groupBy("symbol", chunk).agg(*at).withColumn("block", F.pmod(F.xxhash64("symbol"), F.lit(blocks)))
    lists = [F.col(f"at.{c}").alias(c) for c in ("t", *fields)]
    return out.select("symbol", "block", "chunk", *lists), blocks


def _matrices(part: pd.DataFrame, times: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and sums of squares by time and symbol."""
    out = tuple(np.zeros((len(times), len(part))) for _ in range(3))
    for k, (t, *columns) in enumerate(zip(part["t"], *[part[f"{c}{kind}"] for c in "nsq"], strict=True)):
        where = np.searchsorted(times, t)
        for m, values in zip(out, columns, strict=True):
            m[where, k] = values
    return out


def _met(a: tuple, b: tuple) -> list[np.ndarray]:
    """SUMS of each series of ``a`` with each of ``b``."""
    (na, xa, qa), (nb, xb, qb) = a, b
    return [na.T @ nb, xa.T @ nb, na.T @ xb, qa.T @ nb, na.T @ qb, xa.T @ xb]


def _gram(flagged: bool) -> Callable:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        i, j, _ = key
        sides = [rows[rows["block"] == k].sort_values("symbol") for k in ((i,) if i == j else (i, j))]
        times = np.unique(np.concatenate(rows["t"].to_list()))
        given = [_matrices(p, times, "") for p in sides]
        marked = [_matrices(p, times, "f") for p in sides] if flagged else given
        out = []
        for k, h in ((0, 0),) if i == j else ((0, 1), (1, 0)):
            names, others = (sides[x]["symbol"].to_numpy(dtype=object) for x in (k, h))
            sums = _met(given[k], given[h])
            if flagged:
                sums += _met(marked[k], given[h])
            a, b = np.nonzero((names[:, None] < others[None, :]) & (sums[0] > 0))
            out.append(pd.DataFrame({"a": names[a], "b": others[b]} | dict(zip(_columns(flagged), [m[a, b] for m in sums], strict=True))))
        return pd.concat(out, ignore_index=True)

    return run


def _columns(flagged: bool) -> list[str]:
    return [*SUMS, *([f"{c}_f" for c in SUMS] if flagged else [])]


def moments(rows: DataFrame, value: str, flag: str | None = None, per_block: int = PER_BLOCK, per_chunk: int = PER_CHUNK) -> DataFrame:
    """(a, b, SUMS) of each two symbols a < b of ``rows`` (symbol, ts, ``value``) that have a time in common.

    With ``flag``, SUMS with ``_f`` as well, over the times at which the row of ``a`` is flagged.
    """
    cells, blocks = packed(rows, value, flag, per_block, per_chunk)
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__o")
    met = cells.select("*", other).withColumns({"i": F.least("block", "__o"), "j": F.greatest("block", "__o")}).drop("__o")
    names = _columns(flag is not None)
    schema = "a string, b string, " + ", ".join(f"{c} double" for c in names)
    each = met.groupBy("i", "j", "chunk").applyInPandas(_gram(flag is not None), schema)
    return each.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in names])


def _corr(kind: str = "") -> Column:
    n, sa, sb, saa, sbb, sab = (F.col(f"{c}{kind}") for c in SUMS)
    va, vb = saa - sa * sa / n, sbb - sb * sb / n
    varies = (n > 1) & (va > _FLAT * saa) & (vb > _FLAT * sbb)
    return F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (sab - sa * sb / n) / F.sqrt(va * vb))))


def correlations(rows: DataFrame, value: str, flag: str | None = None, per_block: int = PER_BLOCK, per_chunk: int = PER_CHUNK) -> DataFrame:
    """(a, b, n, corr) of each two symbols a < b; with ``flag``, corr_f over the times at which the row of ``a`` is flagged."""
    m = moments(rows, value, flag, per_block, per_chunk)
    extra = [_corr("_f").alias("corr_f")] if flag else []
    return m.select("a", "b", F.col("n").cast("long").alias("n"), _corr().alias("corr"), *extra)
