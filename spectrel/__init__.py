"""Spectrel: spatial spectrometry analytics on Spark DataFrames."""
