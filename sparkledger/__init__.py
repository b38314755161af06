"""Transaction-fraud analytics on Spark: DataFrame in, DataFrame out."""
