"""Prompt-risk analytics on Spark."""
