"""Operators over interactions: extraction, evaluators, judges, state, telemetry, reports."""
