"""Training-data operators: dedup, quality, language, tokens, decontamination.

Nothing outside this subpackage imports it.
"""
