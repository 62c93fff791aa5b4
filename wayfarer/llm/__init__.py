"""Operations of a training-data pipeline: tokens, archives, filters, duplicates, packing.

Nothing outside this subpackage imports it. ``queries.py`` registers one query for each operator.
"""
