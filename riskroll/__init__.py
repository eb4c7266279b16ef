"""riskroll: a Spark-native engine for case-level scoring features and metrics.

Everything is expressed with the DataFrame API / Spark SQL / Spark ML:

* ``sources``   – parquet families, relaxed unions, CSV lineage, sinks.
* ``functions`` – column-expression helpers (hash randomness, guarded ratios,
  date parts, economic indices).
* ``operators`` – roll-ups, cleaning, joins, sampling, selection, models and
  scoring metrics; every operator is ``DataFrame -> DataFrame`` so it chains
  with ``df.transform``.
* ``plans``     – fixture views over the driver tables and the query catalog.
* ``streaming`` – incremental (micro-batch) metric accumulation.
"""

__version__ = "0.1.0"
