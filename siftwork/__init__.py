"""siftwork: corpus-scale document screening and matching on Spark.

Every operator is a function ``DataFrame(s) -> DataFrame`` built from native
Spark expressions, joins, windows and aggregates.  Lexicons, rules and
templates enter as small dimension tables.
"""

__version__ = "0.1.0"
