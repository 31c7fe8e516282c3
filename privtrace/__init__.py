"""privtrace: Spark DataFrame and Structured Streaming operators that audit
private-data leakage in logs of agent traffic.

Every operator is ``DataFrame -> DataFrame`` (or returns a ``Column``), is
built from native Spark expressions wherever these can express it, and plans
its own work so that no group, key or text has to fit into one task.
"""
__version__ = "0.1.0"
