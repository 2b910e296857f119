"""Stateful folds and Structured Streaming views."""
