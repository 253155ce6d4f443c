"""Training-data operators: deduplication, tokenisation, mixing, filtering and archive conversion on DataFrames."""
