"""Training-data operators: packing, deduplication, scoring, mixing, language and licence checks."""
