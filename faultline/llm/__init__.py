"""Training-data operators: language id, sharding, deduplication, PII, extraction, encoding, fingerprints, packing."""
