"""Spark jobs for conserved gene neighbourhoods, and for preparing training text."""
