"""Training-data operators: cleaning, mixing, sharding, language, secrets, dedup, tokens, archives."""
