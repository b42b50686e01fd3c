"""Result sinks."""

from gleaner.sinks.writer import write_result, write_results

__all__ = ["write_result", "write_results"]
