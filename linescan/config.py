"""What a search is asked to do."""

from __future__ import annotations

from dataclasses import dataclass, replace

MAX_FILE_BYTES = 8 << 20
PROBE_BYTES = 4096
DISPLAY_BYTES = 500


@dataclass(frozen=True)
class SearchConfig:
    """A search, with the filters as they take effect.

    compat_ext and compat_alternation bring back two known quirks: the extension filter that looks at whole file names,
    and alternations that lose their non-literal branches. git_semantics evaluates nested ignore files as git does.
    """

    pattern: str
    force_literal: bool = False
    size_filter: bool = True
    ignore_filter: bool = True
    binary_filter: bool = True
    max_file_bytes: int = MAX_FILE_BYTES
    use_index: bool = True
    compat_ext: bool = False
    compat_alternation: bool = False
    git_semantics: bool = False

    def with_flags(self, unrestricted: int = 0, everything: bool = False, large: bool = False, no_ignore: bool = False, binary: bool = False) -> SearchConfig:
        """The filters that command-line flags switch off; unrestricted counts -u."""
        if unrestricted and (everything or large or no_ignore or binary):
            raise ValueError("-u can't be combined with --all, --large, --no-ignore or --binary")
        all_off = everything or unrestricted >= 3
        return replace(
            self,
            size_filter=self.size_filter and not (all_off or large or unrestricted),
            ignore_filter=self.ignore_filter and not (all_off or no_ignore or unrestricted),
            binary_filter=self.binary_filter and not (all_off or binary),
        )
