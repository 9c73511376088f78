"""Recursive indicators that are no affine maps: one ordered series per symbol in a grouped map."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from tickloom.functions import series as S

#: Name, columns and function of the OHLCV vectors of a symbol.
SERIES = {
    "mama": ("mama double, fama double", lambda o, h, l, c, v: S.mama(c)),
    "vpin": ("vpin double", lambda o, h, l, c, v: (S.vpin(c, v, 50),)),
}


def indicator(bars: DataFrame, name: str, digits: int | None = None) -> DataFrame:
    """(symbol, ts, columns) of a recursive indicator; null until warmed up."""
    schema, fn = SERIES[name]
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        got = fn(*(pdf[k].to_numpy(float) for k in ("open", "high", "low", "close", "volume")))
        out = pdf[["symbol", "ts"]].assign(**dict(zip(columns, got, strict=True)))
        out = out.round(digits) if digits is not None else out
        return out.astype(object).where(out.notna(), None)

    return bars.groupBy("symbol").applyInPandas(run, f"symbol string, ts timestamp_ntz, {schema}")
