"""Windowed monitors (T1–T12) with one definition for batch and Structured Streaming."""
