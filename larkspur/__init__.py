"""larkspur: Spark-native retrieval-augmented answering and run analytics.

Every public operator is a function ``DataFrame -> DataFrame`` (or a small
family of such functions) whose work runs in Spark executors.  Subpackages:

* ``sources``    – table scans, file readers, generators and sinks
* ``functions``  – Column-level helpers (text, vectors, scoring maps, quantiles)
* ``operators``  – joins, rankings, folds, aggregations, scorers
* ``plans``      – composed plans (retrieval, answering, run analytics) and the stage plan
* ``streaming``  – Structured Streaming twins of the batch operators
"""

__version__ = "0.1.0"
