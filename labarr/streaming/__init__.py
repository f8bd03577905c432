"""Selections that are handed out chunk by chunk."""
