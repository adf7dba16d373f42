"""Operators that prepare language-model training data on Spark.

Nothing outside this subpackage imports it.  ``sparkloom.llm.entry`` lists the
queries (``opN_<name>``) and their SQL.
"""
