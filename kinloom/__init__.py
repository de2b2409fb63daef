"""kinloom: a Spark-first record-linkage and data-processing engine."""

__version__ = "0.1.0"
