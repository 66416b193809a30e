"""Readers, adapters from raw tables to the activity model, sinks and sync."""
