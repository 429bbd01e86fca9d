"""Contest analytics on Spark: cleaning, conformed load, reports, history features, win-probability models."""
