"""Operators of a training-data pipeline.  ``contentflow.llm.queries`` registers their queries."""
