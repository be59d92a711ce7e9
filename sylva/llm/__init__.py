"""Training-data operators: deduplication, language, privacy, chat, search, quality, mixing, URL filters.

Nothing else in the library imports this subpackage.
"""
