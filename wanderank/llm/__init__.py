"""Training-data operators: counting, filtering, deduplication, mixing and sharding of documents."""
