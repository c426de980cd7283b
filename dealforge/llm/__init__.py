"""Training-data operators: decontamination, counting, packing, filtering, deduplication."""
