"""tickloom: bars, indicators, backtests, retrieval and streams as Spark DataFrames."""

__version__ = "0.1.0"
