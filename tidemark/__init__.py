"""Market-regime and backtest analytics expressed as Spark DataFrame jobs."""
