"""Text-stream analytics on PySpark: line pipelines, similarity, extraction, prose and session analytics."""
