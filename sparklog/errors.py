"""What a request can be refused with."""

from __future__ import annotations


class LogError(Exception):
    """A refused request."""


class InvalidArgument(LogError):
    """The request contradicts itself or names no such position."""


class NotFound(LogError):
    """The stream or partition does not exist."""


class AlreadyExists(LogError):
    """The stream exists already."""


class FailedPrecondition(LogError):
    """The stream is read-only or paused, or a newer member holds the partition."""


class ResourceExhausted(LogError):
    """A bounded read of an empty log."""
