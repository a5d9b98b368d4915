"""Training-data operators: dedup, search, mixing, packing, language, licences, personal data."""
