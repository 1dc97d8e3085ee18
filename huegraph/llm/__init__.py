"""Training-data operators: token counts, PII, BPE, quality, near duplicates, search, language, toxicity, packing."""
