"""Episodic time-series analytics and training-data preparation as Spark DataFrame transforms."""
