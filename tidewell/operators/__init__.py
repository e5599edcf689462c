"""DataFrame operators: scoring, fusion, full text, retrieval, context and evaluation."""
