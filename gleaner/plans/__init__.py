"""The named catalogue of metrics and the batch runner over it."""
