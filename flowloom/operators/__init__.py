"""DataFrame operators: filters, flows, devices, cleaning, sampling, metrics, models."""
