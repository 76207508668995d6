"""Readers and writers: flow CSV folders, capture files, packet streams, alert logs, models."""
