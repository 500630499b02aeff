"""Training-data operators: decontamination, personal data, quality, near duplicates, sharding, toxicity, mixing,
token counts, chat formatting and exact duplicates.  Nothing outside this package imports it."""
