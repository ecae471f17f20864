"""Training-data operators: near-duplicate search, filtering, extraction and mixing.

Nothing else in the library imports this subpackage.
"""
