"""Quayline: market time-series analytics and text retrieval as Spark DataFrame jobs."""
