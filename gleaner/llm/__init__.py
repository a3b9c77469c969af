"""Training-data operators: sharding, media columns, packing, search, filters, models."""
