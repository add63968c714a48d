"""Operators of a training-data pipeline over the text records of the library."""
