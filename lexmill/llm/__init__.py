"""Training-data operators: deduplication, scans, decontamination, scoring, mixing and sharding of documents.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames; ``queries.py`` binds
them to the tables of a data folder.
"""
