"""Models, pipeline and the query catalogue."""
