"""Operators of a training-data pipeline: quality, language-model scores, toxicity,
token output, near-duplicates, tokenisation, licences, decontamination, personal data.

Nothing outside this subpackage imports it. ``queries.py`` holds the registered
queries; each operator module has its own general interface and docstring."""
