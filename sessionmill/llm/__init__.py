"""Training-data operators: scoring, filtering, deduplication, mixing and packing of documents."""
