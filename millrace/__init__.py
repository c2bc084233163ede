"""A Spark engine for correlating events into flows, and operators for corpora."""
