"""Training-data operators: licences, dedup, sharding, language, tokens, leaks, mixing, secrets, toxicity, quality.

Nothing else in the library imports this subpackage; ``registry`` holds its queries.
"""
