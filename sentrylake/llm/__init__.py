"""Training-data operators: language, mixing, decontamination, near-dedup, scoring, quality,
sharding, toxicity, token counts and web archives. `catalog` registers their queries."""
