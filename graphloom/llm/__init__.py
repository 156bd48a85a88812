"""Training-data operators: language ID, dedup, decontamination, tokenization, search, URL filters."""
