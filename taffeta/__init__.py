"""taffeta: a Spark-native engine for building and judging TAF text-completion corpora.

Layout
------
- ``sources``    readers and writers (raw text, JSON Lines, nested records, split stores)
- ``functions``  Column -> Column building blocks (whitespace, TAF patterns, strings)
- ``operators``  DataFrame -> DataFrame operators (segment, metadata, prefixes, splits,
                 analysis, scoring, strategies, tokens, distributions)
- ``plans``      the registered queries, their DuckDB oracle SQL and the derived fixtures
- ``streaming``  Structured Streaming versions (debounce, incremental prefix pairs)
"""

__version__ = "0.1.0"
