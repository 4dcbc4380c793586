"""Transcript, project-symbol and note analytics expressed as PySpark DataFrame jobs."""
