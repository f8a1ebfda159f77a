"""Training-data operators: filtering, deduplication, decontamination, counting, packing and sharding of documents."""
