"""Agreement keys of document numbers: equal apart from case, spacing, closing punctuation and look-alike characters."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F, types as T

# Letters of other alphabets drawn like a Latin letter, in the order of the Latin letter.
LOOK_ALIKE = {
    "а": "a", "ɑ": "a", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ı": "i", "ι": "i", "ј": "j",
    "ӏ": "l", "ո": "n", "о": "o", "ο": "o", "р": "p", "ρ": "p", "ԛ": "q", "ѕ": "s", "υ": "u", "ν": "v", "ѵ": "v",
    "ԝ": "w", "х": "x", "χ": "x", "у": "y", "γ": "y", "α": "a", "к": "k", "κ": "k", "м": "m", "μ": "m", "т": "t", "τ": "t",
    "в": "b", "β": "b", "н": "h", "η": "h", "ε": "e", "ζ": "z", "ð": "đ", "ɖ": "đ", "‐": "-", "−": "-",
}
_TABLE = str.maketrans(LOOK_ALIKE)
_HIDDEN = {"Cf", "Cc", "Zs", "Zl", "Zp"}
# Marks that cannot be seen; all others tell numbers apart unless they compose.
_UNSEEN_MARKS = {"\u034f", *map(chr, range(0x180B, 0x1810)), *map(chr, range(0xFE00, 0xFE10)), *map(chr, range(0xE0100, 0xE01F0))}


def number_key(value: str | None) -> str | None:
    """The agreement key of one document number.

    Null stays null. Compatibility forms fold to ordinary characters, accents are composed, spaces and invisible
    characters vanish, capital look-alikes fold with the lower-case letter they share a capital with.
    """
    if value is None:
        return None
    text = unicodedata.normalize("NFKC", value).lower()
    text = "".join(c for c in text if unicodedata.category(c) not in _HIDDEN and c not in _UNSEEN_MARKS)
    return unicodedata.normalize("NFC", text.translate(_TABLE)).rstrip(".,;)")


@F.pandas_udf(T.StringType())
def number_key_udf(values: pd.Series) -> pd.Series:
    """``number_key`` over Arrow batches; each distinct spelling of a batch is folded once."""
    keys = {v: number_key(v) for v in values.dropna().unique()}
    return pd.Series([None if v is None or v != v else keys[v] for v in values], dtype=object)
