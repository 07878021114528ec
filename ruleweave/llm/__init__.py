"""Training-data operators: each module holds one operator and its general interface.

Nothing outside this package imports it; ``__spark_entry__`` adds the
queries in :mod:`ruleweave.llm.queries` only where the package exists.
"""
