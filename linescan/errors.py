"""What can go wrong, and the exit code of each case."""

from __future__ import annotations


class SearchError(Exception):
    """A search that can't be carried out."""

    exit_code = 1


class PatternError(SearchError):
    """The pattern isn't valid, or has what a linear-time matcher can't express."""

    exit_code = 2


class InputMissing(SearchError):
    """There is no such file, directory or image."""

    exit_code = 66


class NoPermission(SearchError):
    """The input may not be read."""

    exit_code = 77


class UnknownFilesystem(SearchError):
    """The image has no magic number of a filesystem that can be read."""


class BrokenImage(SearchError):
    """The image contradicts itself."""


def exit_code(error: BaseException | None) -> int:
    """0 without an error, also where nothing matched."""
    if error is None:
        return 0
    if isinstance(error, SearchError):
        return error.exit_code
    if isinstance(error, PermissionError):
        return NoPermission.exit_code
    if isinstance(error, FileNotFoundError):
        return InputMissing.exit_code
    return 1
