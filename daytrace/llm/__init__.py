"""Training-data operators: deduplication, language, personal data, licences, mixing, tokens and media.

Nothing outside this subpackage imports it.
"""
