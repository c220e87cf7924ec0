"""Column-name rules evaluated on ``df.columns``.

These decide *which* columns an operator touches; the operators themselves
are DataFrame projections.  Only schema names are involved, never data.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from .. import constants as K


def check_unambiguous(columns: Sequence[str]) -> None:
    """Spark resolves names case-insensitively; refuse inputs where two
    columns differ only by case, or repeat."""
    seen: dict[str, str] = {}
    for c in columns:
        key = c.lower()
        if key in seen:
            raise ValueError(f"ambiguous columns {seen[key]!r} and {c!r}: names must be unique "
                             "ignoring case")
        seen[key] = c


def contains_any(name: str, words: Iterable[str]) -> bool:
    low = name.lower()
    return any(w in low for w in words)


def contains_word(name: str, words: Iterable[str]) -> bool:
    """Like ``contains_any`` for whole words: 'age' is in 'customer_age' but
    not in 'percentage'."""
    parts = re.split(r"[^a-z0-9]+", name.lower())
    return any(w in parts for w in words)


def leakage_columns(columns: Sequence[str], mode: str = "substring") -> list[str]:
    """PR2 (``substring``: the 12-name list) or PR3 (``keyword``: 10 broad words)."""
    words = K.LEAKAGE_SUBSTRINGS if mode == "substring" else K.LEAKAGE_KEYWORDS
    return [c for c in columns if contains_any(c, words)]


def find_target_exact(columns: Sequence[str], names: Sequence[str] = K.TARGET_NAMES,
                      strip: bool = True, last_match: bool = False) -> str | None:
    """PR4: first (or last) column whose lower-cased, optionally stripped,
    name is one of ``names``."""
    wanted = {n.lower() for n in names}
    hit = None
    for c in columns:
        key = c.lower().strip() if strip else c.lower()
        if key in wanted:
            hit = c
            if not last_match:
                break
    return hit


def find_target_keyword(columns: Sequence[str], with_exclusions: bool = True) -> str | None:
    """PR5: first column containing a target keyword (and, at fit time, none
    of the exclusion words)."""
    for c in columns:
        if contains_any(c, K.TARGET_KEYWORDS):
            if with_exclusions and contains_any(c, K.TARGET_EXCLUSIONS):
                continue
            return c
    return None


def map_canonical(columns: Sequence[str]) -> dict[str, str]:
    """PR7: canonical feature → source column.

    Exact alias match (lower+strip) first, in column order; otherwise the
    first column where an alias is a substring of the lower-cased name or the
    name a substring of an alias.  A source column may feed several features.
    """
    mapping: dict[str, str] = {}
    for feature, aliases in K.CANONICAL_ALIASES.items():
        lowered = [a.lower() for a in aliases]
        hit = next((c for c in columns if c.lower().strip() in lowered), None)
        if hit is None:
            for c in columns:
                low = c.lower()
                if any(a in low or low in a for a in lowered):
                    hit = c
                    break
        if hit is not None:
            mapping[feature] = hit
    return mapping


def relevant_columns(columns: Sequence[str], limit: int | None = None, word_match: bool = False) -> list[str]:
    """PR9: names containing one of the relevant words (first ``limit``), with
    ``word_match`` only as a whole word."""
    found = contains_word if word_match else contains_any
    out = [c for c in columns if found(c, K.RELEVANT_WORDS)]
    return out if limit is None else out[:limit]


def plain_family(name: str) -> int | None:
    """Index of the first plain-rule family (SC1) whose word is in ``name``."""
    for i, (words, _) in enumerate(K.PLAIN_RULES):
        if contains_any(name, words):
            return i
    return None
