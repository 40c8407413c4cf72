"""All queries of this subpackage; importing it fills the registry."""

from veritrace.llm import (  # noqa: F401
    alignment, bpe, chat, collocations, packing, quality, sharding, simhash, token_counts, topk, toxicity, warc, winnowing,
)
from veritrace.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
