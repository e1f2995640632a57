"""Readers, sinks and schemas."""
