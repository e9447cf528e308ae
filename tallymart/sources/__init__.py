"""Readers, writers and generators at the edges of the pipeline."""
