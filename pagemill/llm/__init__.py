"""Training-data operators: packing, deduplication, personal data, quality,
toxicity, mixing and sharding, each a Spark job over a documents table."""
