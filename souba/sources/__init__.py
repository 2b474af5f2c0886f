"""Landed JSON / HTML sources and file sinks."""
