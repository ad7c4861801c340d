"""Training-data operators at corpus scale.

Nothing outside this subpackage imports it; ``queries.py`` registers its
queries and ``__spark_entry__.py`` adds them only when the import works.
"""
