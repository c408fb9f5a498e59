"""Spatial labelling and training-data operators as Spark jobs."""
