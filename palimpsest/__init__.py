"""Palimpsest: multi-version change-log analytics on PySpark."""
