"""Column-level functions: normalisers, text rules and response parsers."""
