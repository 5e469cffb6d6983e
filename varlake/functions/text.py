"""Driver-side handling of field names."""

from __future__ import annotations

import re
from collections.abc import Callable


def field_name_normaliser(replacement: str = "_") -> Callable[[str], str]:
    """A function that replaces every run of characters outside ``[A-Za-z0-9_]``.

    The default gives names that need no quoting in SQL; pass ``"."`` for dotted names.
    """
    outside = re.compile(r"[^A-Za-z0-9_]+")

    def normalise(raw: str) -> str:
        return outside.sub(replacement, raw.strip())

    return normalise
