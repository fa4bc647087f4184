"""Dataflow operators over pages, clauses, chunks and results."""
