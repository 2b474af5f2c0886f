"""Operators for training-data pipelines: fingerprints, archives, shards, filters, joins, formats, mixes."""
