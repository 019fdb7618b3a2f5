"""All queries of this subpackage."""

from featloom.llm import chat, decontaminate, html, language, licences, mixture, neardup, passages, periodic, phrases, toxicity, urls, vectors  # noqa: F401
from featloom.llm.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
