"""leadflow: lead-and-booking analytics expressed as Spark DataFrame plans.

Sub-packages:

* ``sources``   - readers, writers, the fact-table schema and the test fixture views
* ``functions`` - Column-level building blocks (time windows, predicates, metrics, text, masking)
* ``operators`` - DataFrame -> DataFrame operators (metric query, top-k, agents, similarity, ...)
* ``streaming`` - Structured Streaming jobs
* ``plans``     - the registered queries and their independent DuckDB oracles
"""

__version__ = "0.1.0"
