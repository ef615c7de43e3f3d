"""DataFrame operators: enrichment, queries, rollups, detection, investigation, quality, telemetry."""
