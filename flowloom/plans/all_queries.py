"""Imports every query module once, which fills the catalog."""

from flowloom.plans import capture_queries, device_queries, flow_queries, model_queries, packet_queries, stream_queries, training_queries  # noqa: F401
from flowloom.plans.catalog import CHECKS, QUERIES  # noqa: F401
