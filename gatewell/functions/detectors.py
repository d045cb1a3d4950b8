"""Patterns that recognise personal data in text."""

from __future__ import annotations

from pyspark.sql import Column

# One pattern per kind of personal data. They use only syntax that all common regex
# engines read alike (no word borders, which differ on accented letters). The part before an @ is
# taken whole, however long; only texts with an @ are searched for it.
DETECTORS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "card": r"[0-9]{13,}",
    "phone": r"\+[0-9]{1,3}[ -]\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{3,4}",
}
# What a masked match is replaced by.
REPLACEMENTS = {"email": "<email>", "ipv4": "<ipv4>", "card": "<card>", "phone": "<phone>"}


def found(column: Column, detector: str) -> Column:
    """Whether the text holds a match. A plain substring test spares most rows the pattern."""
    match = column.rlike(DETECTORS[detector])
    if detector == "email":
        return column.contains("@") & match
    if detector == "phone":
        return column.contains("+") & match
    return match


def masked_sql(column: str) -> str:
    """SQL text for the column with every match of every detector replaced."""
    def replaced(value: str, detector: str) -> str:
        return f"regexp_replace({value}, r'{DETECTORS[detector]}', '{REPLACEMENTS[detector]}')"

    # The e-mail pattern is by far the dearest and few texts have an @, so it goes first, on the
    # bare column, behind a substring test.
    result = (f"CASE WHEN contains({column}, '@') THEN {replaced(column, 'email')} "
              f"ELSE {column} END")
    for detector in DETECTORS:
        if detector != "email":
            result = replaced(result, detector)
    return result
