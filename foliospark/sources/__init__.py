"""Readers, sinks and replaceable providers."""
