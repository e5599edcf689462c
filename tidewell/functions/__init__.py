"""Column functions: text, language detection, query enhancement and embeddings."""
