"""Operators of a training-data pipeline: language, copies, leaks, personal data, packing, scores."""
