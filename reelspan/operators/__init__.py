"""Operators on transcript tables: interval algebra, editing, chunks, clips, model boundary."""
