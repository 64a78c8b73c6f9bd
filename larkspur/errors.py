"""Errors of the engine."""


class EngineError(Exception):
    """Base of all."""


class BadRequest(EngineError, ValueError):
    """A request, mapping or document that can't be read."""


class NotFound(EngineError, KeyError):
    """An index, alias or template that isn't there."""
