"""Checksums of structured identifiers as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the Italian tax code at odd places, for 0-9 and A-J alike and then K-Z.
CF_ODD_FIRST_TEN = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21)
CF_ODD_K_TO_Z = (2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)
# IBAN lengths by country.
IBAN_LENGTHS = {"IT": 27, "SM": 27, "VA": 22, "DE": 22, "FR": 27, "ES": 24, "GB": 22, "CH": 21, "NL": 18, "BE": 16, "LU": 20, "AT": 20, "PT": 25, "IE": 22}

_ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ODD = "".join(chr(65 + w) for w in (*CF_ODD_FIRST_TEN, *CF_ODD_FIRST_TEN, *CF_ODD_K_TO_Z))
_EVEN = "".join(chr(65 + int(c, 36) - (10 if c > "9" else 0)) for c in _ALNUM)


def _sum(letters: Column) -> Column:
    """Sum of letters as numbers from A = 0."""
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.length(letters), F.lit(1))), lambda i: F.ascii(F.substr(letters, i, F.lit(1))) - 65), F.lit(0), lambda a, x: a + x)


def _every_other(text: Column, first: int) -> Column:
    pattern = "(.)." if first == 1 else ".(.)"
    return F.array_join(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), "")


def cf_check_letter(first_fifteen: Column) -> Column:
    """Check letter of the first fifteen characters of an Italian tax code; null for other text."""
    value = F.upper(first_fifteen)
    padded = F.concat(value, F.lit("0"))
    odd = F.translate(_every_other(padded, 1), _ALNUM, _ODD)
    even = F.translate(F.substring(_every_other(padded, 2), 1, 7), _ALNUM, _EVEN)
    return F.when(value.rlike("^[0-9A-Z]{15}$"), F.char((_sum(odd) + _sum(even)) % 26 + 65))


def is_cf(value: Column) -> Column:
    upper = F.upper(value)
    return F.coalesce((F.length(upper) == 16) & (cf_check_letter(F.substring(upper, 1, 15)) == F.substring(upper, 16, 1)), F.lit(False))


def is_vat(value: Column) -> Column:
    """Eleven digits that pass the Luhn check."""
    return F.coalesce(value.rlike("^[0-9]{11}$") & F.call_function("luhn_check", value), F.lit(False))


def mod97(value: Column) -> Column:
    """Remainder by 97 of the base-36 expansion, digit by digit."""
    chars = F.transform(F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1))), lambda i: F.substr(value, i, F.lit(1)))
    number = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda a, c: (F.when(number(c) > 9, a * 100).otherwise(a * 10) + number(c)) % 97)


def is_iban(value: Column) -> Column:
    upper = F.upper(value)
    moved = F.concat(F.substr(upper, F.lit(5)), F.substring(upper, 1, 4))
    return F.coalesce(upper.rlike("^[A-Z0-9]{15,}$") & (mod97(moved) == 1), F.lit(False))


def iban_check_digits(country: Column, bban: Column) -> Column:
    return F.lpad((F.lit(98) - mod97(F.concat(F.upper(bban), F.upper(country), F.lit("00")))).cast("string"), 2, "0")
