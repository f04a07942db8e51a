"""Environmental-telemetry analytics on PySpark DataFrames."""
