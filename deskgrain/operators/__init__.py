"""Operators on tables of articles, questions, chunks, answers and events."""
