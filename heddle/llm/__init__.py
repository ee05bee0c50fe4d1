"""Training-data operators: near-duplicate search, filtering, scanning, scoring and mixing of text corpora.

Nothing outside this subpackage imports it.  ``registry.py`` lists its queries.
"""
