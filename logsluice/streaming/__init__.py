"""Structured Streaming: onboarding, windows, duplicates, sessions, drift."""
