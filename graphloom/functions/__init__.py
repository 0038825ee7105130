"""Column functions: text, model-output grammars, vectors."""
