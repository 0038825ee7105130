"""Question-answering datasets, and the graph as JSON."""
