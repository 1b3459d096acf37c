"""The same questions in plain SQL for an independent engine, to check results against."""
