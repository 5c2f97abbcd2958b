"""An engine for keyed event logs on PySpark."""
