"""Training-data operators: deduplication, tokenization, licences, archives, mixing, search and quality."""
