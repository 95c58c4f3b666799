"""Siltstone: raw log lines to canonical, comparable events on PySpark."""
