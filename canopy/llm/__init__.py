"""Training-data operators: tokenising, sharding, media, near duplicates, search, mixing, counting, line dedup, language and toxicity."""
