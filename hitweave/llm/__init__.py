"""Operators for preparing training text: decontamination, deduplication, classifiers,
tokenisation, page extraction and web archives.  Nothing else in the library imports this."""
