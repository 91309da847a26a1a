"""Readers of spans, records and turns."""
