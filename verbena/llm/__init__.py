"""Training-data operators: quality ledger, licence scan, neighbours, near duplicates,
repeated passages, page wrappers, packing, line dedup, token counts and source mixing."""
