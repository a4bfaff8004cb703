"""Trackloom: trajectory, interval and event-stream analytics written as Spark plans."""

__version__ = "0.1.0"
