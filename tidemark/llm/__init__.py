"""Operators of a training-data pipeline and their queries; nothing outside imports this folder."""

from tidemark.llm.queries import ORACLE, QUERIES  # noqa: F401
