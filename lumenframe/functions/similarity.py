"""Similarity of short category names."""

from __future__ import annotations

import re
from difflib import SequenceMatcher


def token_sort_key(text: str) -> str:
    """ASCII letters and digits, lower case, words in order."""
    kept = "".join(ch for ch in text if ord(ch) < 128)
    return " ".join(sorted(re.sub(r"(?ui)\W", " ", kept).lower().split()))


def ratio_above(a: str, b: str, threshold: int) -> bool:
    """Whether the matched-character ratio, rounded to a percent, exceeds the threshold.

    The two cheap ratios are upper bounds of the real one, so they only skip certain misses.
    """
    if not a or not b:
        return False
    m = SequenceMatcher(None, a, b)
    for bound in (m.real_quick_ratio, m.quick_ratio):
        if round(100 * bound()) <= threshold:
            return False
    return round(100 * m.ratio()) > threshold
