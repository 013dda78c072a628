"""Schemas, configuration, runtime helpers, jobs and the query catalogue."""
