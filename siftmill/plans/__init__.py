"""Queries over the tables of a corpus: what the engine answers, each with SQL for comparison where SQL can express it."""
