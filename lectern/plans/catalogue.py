"""The registered queries of the corpus operators, with equivalent SQL."""

from __future__ import annotations

from lectern.plans import answers, chunks, concepts, corpus, evaluation, ingest, library, markup, metadata, notes, references, registry_queries, search, skeleton, stored, taxonomy, texts, vectors, versions, vocabulary
from lectern.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "answers", "chunks", "concepts", "corpus", "evaluation", "ingest", "library", "markup", "metadata", "notes", "references", "registry_queries", "search", "skeleton", "stored", "taxonomy", "texts", "vectors", "versions", "vocabulary"]
