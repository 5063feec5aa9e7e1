"""Training-data operators: filtering, deduplication, formatting, archives and mixing.

Nothing else in the library imports this subpackage.
"""
