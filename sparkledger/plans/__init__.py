"""Registered queries: importing this package registers those of every module."""

from . import catalog, corpora, extraction, models, records

__all__ = ["catalog", "corpora", "extraction", "models", "records"]
