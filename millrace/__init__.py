"""millrace: a Spark-first dataflow analytics engine."""

__version__ = "0.1.0"
