"""Result sinks."""

from .writers import preview, write_index, write_stand_lines

__all__ = ["preview", "write_index", "write_stand_lines"]
