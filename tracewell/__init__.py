"""Agent-log analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns a lazy DataFrame.  ``functions``
holds Column helpers, ``sources`` readers and sinks, ``operators`` the batch
operators, ``streaming`` their Structured Streaming forms and ``plans`` the
queries registered for the driver together with their check SQL.
"""
