"""Pluvion: extremes in gridded space-time series and the data checks around them, as Spark jobs."""
