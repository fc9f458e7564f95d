"""Relational building blocks over telemetry, dimensions and lifespans."""
