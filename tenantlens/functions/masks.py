"""Masking columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What an unprivileged reader sees instead of free text and patient ids.
TEXT_MASK = "[MASKED - ADMIN ONLY]"
PATIENT_MASK = "***-PHI-MASKED-***"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mask_email(c: Column | str) -> Column:
    """Up to two leading characters and the domain stay."""
    return F.regexp_replace(_col(c), r"(^[^@]{1,2})[^@]*(@.*)", "$1***$2")


def mask_phone(c: Column | str) -> Column:
    """First and last two digits of every digit run stay."""
    return F.regexp_replace(_col(c), r"(\d{2})(\d+)(\d{2})", "$1****$3")


def mask_name(c: Column | str) -> Column:
    return F.concat(F.split_part(_col(c), F.lit(" "), F.lit(1)), F.lit(" ****"))


def mask_text(c: Column | str) -> Column:
    return F.when(_col(c).isNotNull(), F.lit(TEXT_MASK))


def mask_patient_id(c: Column | str) -> Column:
    return F.lit(PATIENT_MASK)


MASKS = {"email": mask_email, "phone": mask_phone, "name": mask_name, "text": mask_text, "patient_id": mask_patient_id}
