"""Driver-side parameter rules (no data touched)."""

from __future__ import annotations

DEFAULT_LIMIT = 100
MAX_LIMIT = 1000


def clamp_limit(limit: int | None, default: int = DEFAULT_LIMIT,
                cap: int = MAX_LIMIT) -> int:
    """min(limit, cap) with a default."""
    n = default if limit is None else int(limit)
    if n < 0:
        raise ValueError("limit must not be negative")
    return min(n, cap)


def resolve_offset(offset: int | None, page: int | None, limit: int) -> int:
    """Offset wins over a 1-based page; page 0 means offset 0 (K1)."""
    if offset is not None:
        if offset < 0:
            raise ValueError("offset must not be negative")
        return int(offset)
    if page is None or page <= 0:
        return 0
    return (int(page) - 1) * limit
