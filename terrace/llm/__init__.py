"""Training-data operators: media chunks, shards, near-duplicates, quality, language,
token files, mixing, SentencePiece, secrets and embeddings."""
