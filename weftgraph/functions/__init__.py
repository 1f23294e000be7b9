"""Column builders: predicates, text, paths, URLs, spans and code conventions."""
