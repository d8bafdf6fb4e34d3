"""Training-data operators: tokenising, deduplication, extraction, decontamination, language ID."""
