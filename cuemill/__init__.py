"""A PySpark engine for timed transcripts, the jobs that make them, and text corpora."""
