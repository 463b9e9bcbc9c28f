"""Operators of a training-data pipeline, each a Spark job of its own: packing, approximate neighbours, mixing,
near-duplicates, token files, suffix-array and exact dedup, language ID, license scans, line dedup.

Nothing outside this package imports it; ``queries.py`` registers one ``opN_<name>`` query per operator.
"""
