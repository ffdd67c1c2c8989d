"""Training-data operators: formatting, media, decontamination, counting, tokens, near-duplicates and filtering.

Nothing outside this subpackage imports it.
"""
