"""Error classes of the package."""

from __future__ import annotations


class StationlakeError(Exception):
    """Base of all errors raised on purpose here."""


class FetchError(StationlakeError, OSError):
    """A document could not be fetched or is no JSON."""


class NotModified(StationlakeError):
    """The server has nothing newer than what the caller's tags name."""


class DiscoveryError(StationlakeError, KeyError):
    """A system has no address, or doesn't publish the feed asked for."""

    def __str__(self) -> str:
        return str(self.args[0]) if self.args else ""
