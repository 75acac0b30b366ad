"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it; ``queries.py`` holds the queries that
``__spark_entry__.py`` registers when the subpackage is present.
"""
