"""Errors of the language and of binding it to data."""

from __future__ import annotations


class ParseError(ValueError):
    """A text that is not of the language; ``pos`` counts bytes."""

    def __init__(self, message: str, pos: int):
        super().__init__(f"{message} at pos {pos}")
        self.message, self.pos = message, pos


class AnalysisError(ValueError):
    """A statement that has no meaning for the given catalogue."""
