"""Timed-text and speech-timeline analytics on Spark."""
