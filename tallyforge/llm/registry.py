"""All queries of the subpackage and the SQL that states their results."""

from __future__ import annotations

from tallyforge.llm import embeddings, exact, fingerprints, infill, language, mixing, packing, resampling, secrets, simhash, suffixes, urls, warc

_MODULES = (secrets, fingerprints, urls, simhash, suffixes, embeddings, mixing, warc, packing, language, exact, resampling, infill)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
