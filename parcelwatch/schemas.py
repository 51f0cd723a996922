"""Column layouts shared by all operators."""

from __future__ import annotations

#: Layout of every finding; ``pkg`` and ``version`` name the release it belongs to.
FINDING_COLUMNS = [
    "pkg", "version", "scanner", "severity", "rule_id", "message", "file", "line", "evidence",
]
