"""SQL text for expressions that are long lists of like terms."""

from __future__ import annotations


def quote(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
