"""Names of inner columns, which never hide a column of the caller."""

from __future__ import annotations

from collections.abc import Iterable


def free(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores after it as it takes until it is none of ``taken``."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"
