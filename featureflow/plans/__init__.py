"""Steps, pipelines, their events and instruments."""
