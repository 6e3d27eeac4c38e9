"""Descriptions of objects on the driver."""
