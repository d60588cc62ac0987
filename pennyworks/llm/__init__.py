"""Training-data operators: packing, filtering, deduplication, extraction and scoring."""
