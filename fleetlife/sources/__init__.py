"""Reading telemetry, attribute tables and catalogues; writing and replacing result tables."""
