"""Checks of the formats that filled forms must keep, as column expressions; null for null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The message of each check that fails.
MESSAGES = {"id_card": "[LỖI: Định dạng số CMND/CCCD không hợp lệ]", "phone": "[LỖI: Số điện thoại không hợp lệ]", "tax_number": "[LỖI: Định dạng MST không hợp lệ]", "email": "[LỖI: Định dạng email không hợp lệ]", "date": "[LỖI: Định dạng ngày tháng không hợp lệ]"}
# The pattern of each format.
PATTERNS = {"id_card": r"^(\d{9}|\d{12})$", "phone": r"^0[35789]\d{8}$", "tax_number": r"^\d{10}(-\d{3})?$", "email": r"^[^\s@]+@[^\s@]+\.[^\s@.]+$", "date": r"^\d{2}/\d{2}/\d{4}$"}


def valid(kind: str, c: Column) -> Column:
    """Whether a value has the format; a date must also exist in the calendar."""
    fits = c.rlike(PATTERNS[kind])
    return fits & F.try_to_timestamp(c, F.lit("dd/MM/yyyy")).isNotNull() if kind == "date" else fits


def checked(kind: str, c: Column) -> Column:
    """The value, or the message of its check."""
    return F.when(c.isNull() | valid(kind, c), c).otherwise(MESSAGES[kind])
