"""Readers of the formats that studies come in, and sinks."""
