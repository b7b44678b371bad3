"""Operators a training-data pipeline needs; nothing outside this subpackage imports it."""
