"""Training-data operators: packing, fingerprints, language, token files, contamination, URLs,
chat, near-duplicates, quality, sharding, token counts, phrases and repetitions. Nothing else in the library imports this package."""
