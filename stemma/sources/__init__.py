"""Readers and writers of the formats that build tracing, vulnerability tracking and packaging exchange."""
