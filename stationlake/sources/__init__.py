"""Feed documents, the systems catalogue and the Parquet lake."""
