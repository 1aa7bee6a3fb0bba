"""Annotation analytics for page collections, written as Spark DataFrame jobs."""
