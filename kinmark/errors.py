"""What can go wrong, and the rule that many failures are one."""

from __future__ import annotations

from collections.abc import Iterable


class BirthmarkError(Exception):
    """Base of all errors that users can cause."""


class NotFound(BirthmarkError):
    """A path does not exist."""


class NotFile(BirthmarkError):
    """A path is a directory."""


class NoExtension(BirthmarkError):
    """A path has no extension to tell its kind by."""


class UnsupportedFormat(BirthmarkError):
    """The extension is neither ``ll`` nor ``bc``, or the kind can't be read here."""


class FormatError(BirthmarkError):
    """A module can't be parsed."""


class JsonError(BirthmarkError):
    """A document is not an array of birthmarks."""


class IoError(BirthmarkError):
    """A file can't be read or written."""


class FatalError(BirthmarkError):
    """The request makes no sense for this input."""


class NotImplementedYet(BirthmarkError):
    """A command that exists but does nothing yet."""


class ErrorArray(BirthmarkError):
    """Several failures together."""

    def __init__(self, errors: list[Exception]):
        super().__init__("; ".join(f"{type(e).__name__}: {e}" for e in errors))
        self.errors = errors


def raise_all(errors: Iterable[Exception]) -> None:
    """Nothing for no error, that error for one, all together for more."""
    errors = list(errors)
    if len(errors) == 1:
        raise errors[0]
    if errors:
        raise ErrorArray(errors)
