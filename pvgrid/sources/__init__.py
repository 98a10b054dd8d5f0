"""Readers for telemetry, metadata and address points, and result writers."""
