"""Sinks with a fixed row order and column order."""
