"""Tables in the folder that all executors and the driver share."""

from colloquy.sources.shared import written

__all__ = ["written"]
