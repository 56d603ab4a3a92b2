"""Transaction-ledger audit on Spark: DataFrame in, DataFrame out."""
