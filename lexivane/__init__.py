"""Documentation retrieval as Spark jobs over tables.

Corpora become cleaned, heading-aware, linked chunks; chunks become postings
and embeddings; tables of queries become ranked, fused, expanded results.
Every operator takes and returns DataFrames (or Columns).
"""
