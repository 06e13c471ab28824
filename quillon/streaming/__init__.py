"""Runs that go on where the last one ended."""
