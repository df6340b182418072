"""Training-data operators: near-duplicates, licences, tokens, toxicity, quality, leaks, chat and lines."""
