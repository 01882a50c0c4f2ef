"""Imports the modules that register queries."""

from lexivane.llm import chat, decontaminate, edit_embedding, hard_negatives, jaccard, licenses, lm, mixing, prefix_trie, quality, secrets, sharding, token_files  # noqa: F401
from lexivane.llm.common import QUERIES, SQL  # noqa: F401
