"""Column-expression builders and fixed vocabularies."""
