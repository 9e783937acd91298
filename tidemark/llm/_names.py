"""Names of working columns that no input column has."""

from __future__ import annotations

from collections.abc import Iterable


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each lengthened until no name in ``taken`` equals it in any case."""
    held, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out
