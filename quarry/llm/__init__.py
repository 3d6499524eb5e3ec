"""Operators of a training-data pipeline (language, secrets, quality, tokens, duplicates).

Nothing else in ``quarry`` imports this subpackage; ``__spark_entry__.py`` adds
its queries only where it can be imported.
"""
