"""Structured Streaming forms of the flow, device, name and health operators."""
