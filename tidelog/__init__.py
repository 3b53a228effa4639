"""Keyed-log and object analytics as Spark plans."""
