"""ledgerloom: durable application state and the analytics over it, as Spark DataFrames."""
