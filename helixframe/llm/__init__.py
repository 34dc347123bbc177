"""Training-data operators: URL filters, decontamination, token counts, WARC
archives, piece segmentation, toxicity, quality rules, near-duplicates,
language ID and line dedup.

Each module holds one operator with its general interface; ``queries.py``
registers the thin ``opN_<name>`` queries and their SQL.  Nothing outside this
sub-package imports it.
"""
