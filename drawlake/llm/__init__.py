"""Training-data operators: extraction, formatting, de-duplication, mixing, scoring, tokens, scans and media."""
