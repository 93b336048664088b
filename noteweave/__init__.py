"""Noteweave: span analytics and training-data operators over clinical notes, on Spark."""
