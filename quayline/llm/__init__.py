"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

from quayline.operators import bitfilter  # noqa: F401
