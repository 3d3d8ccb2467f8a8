"""skeinql: a Spark-first multi-model analytics engine (DataFrame / SQL / Structured Streaming)."""

__version__ = "0.1.0"
