"""Readers, snapshot sinks and pluggable providers."""
