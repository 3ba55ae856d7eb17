"""Named queries and their comparison SQL."""

from . import candidates, choices, corpus, curation, examples, extraction, features, gates, reports, rewards, translation
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "candidates", "choices", "corpus", "curation", "examples", "extraction", "features", "gates", "reports", "rewards", "translation"]
