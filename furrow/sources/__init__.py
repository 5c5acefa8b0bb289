"""Readers, sinks and the raw table layouts."""
