"""Where tables come from: Parquet directories, derived state views, and the durable store."""
