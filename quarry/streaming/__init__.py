"""Incremental run of the sensor job's stateless part (the reference has no streaming)."""

from quarry.streaming.sensor_stream import start_sensor_stream

__all__ = ["start_sensor_stream"]
