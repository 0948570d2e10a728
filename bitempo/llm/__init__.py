"""Operators of a training-data pipeline: text in, decisions and token files out."""
