"""Relational operators of the retrieval engine: extraction, aggregation, graph, packing, search, evaluation."""
