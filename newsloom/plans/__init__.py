"""Operators joined into whole jobs."""
