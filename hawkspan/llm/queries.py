"""All queries of this subpackage."""

from hawkspan.llm import ann, byte_bpe, exact_dedup, fill_middle, language_id, mixing, ngram_join, phrases, pii, secrets, token_files, variants, warc  # noqa: F401
from hawkspan.llm.base import REGISTRY


def queries():
    return {name: entry.run for name, entry in REGISTRY.items()}


def oracle_sql():
    return {name: entry.sql for name, entry in REGISTRY.items() if entry.sql is not None}
