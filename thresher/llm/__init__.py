"""Training-data operators: tokenising, deduplication, decontamination, scoring, sharding.

Nothing else in the library imports this subpackage.  Importing it is cheap: the operators
are plain modules, and ``thresher.llm.queries`` registers one query for each.
"""
