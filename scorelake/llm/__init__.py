"""Operators for large training-data pipelines (documents, pages, labels, benchmark tables).

Nothing else in the package imports this subpackage.  Each module holds one operator with its
own interface; ``queries`` holds the thin contract queries and their SQL.
"""
