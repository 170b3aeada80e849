"""Column expressions that normalise names, addresses, e-mails, phones and postal codes.

All are built-in functions, but for NFKC, which Spark lacks: an Arrow UDF that is handed only texts
with characters beyond ASCII.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Whole words of addresses and their short forms.
STREET_WORDS = {"street": "st", "road": "rd", "avenue": "ave", "boulevard": "blvd", "drive": "dr", "lane": "ln", "apartment": "apt"}
#: Soundex digits of A to Z; zero-coded letters, H and W among them, part equal codes.
LETTERS, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01230120022455012623010202"


#: White space, as a class of a pattern.
WHITE = r"\s\x1C-\x1F\u1680\u2000-\u2006\u2008-\u200A\u2028\u2029\u205F\u3000"
#: Calling codes of countries other than the North American ones, as a pattern.
COUNTRIES = r"7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[12368]|2[2346]\d|25[0-8]|29[01789]|35\d|37[0-8]|38[0-35-79]|42[013]|50\d|59\d|67[02-9]|68[0-35-9]|69[0-2]|8[08]0|85[02356]|870|87[08]|88[1-368]|96[0-8]|97[0-79]|99[2-68]"
#: How an extension is written behind a number.
EXTENSION = r"(?i)[\s,;]*(?:;ext=|extension|extn?\.?|int\.?|x|#|~)[\s.:]*\d{1,7}#?\s*$"


def present(text: Column) -> Column:
    """The text, or null if it is blank: all white space of Unicode but spaces that don't break."""
    return F.when(~text.rlike(rf"^[{WHITE}]*$"), text)


def trimmed(text: Column) -> Column:
    """Without characters up to U+0020 at either end."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column) -> Column:
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def _words(text: Column, keep: str) -> Column:
    plain = F.regexp_replace(F.lower(nfkc(present(text))), rf"[^\p{{L}}\p{{N}}\s{keep}]", " ")
    return F.regexp_replace(trimmed(plain), r"\s+", " ")


def normalize_name(text: Column) -> Column:
    """Lower case, letters and digits, single spaces; blank becomes null, only punctuation empty."""
    return _words(text, "")


def normalize_address(text: Column) -> Column:
    """As a name, but keeps # and -, and shortens street words."""
    out = _words(text, "#-")
    for word, short in STREET_WORDS.items():
        out = F.regexp_replace(out, rf"\b{word}\b", short)
    return out


def first_token(name: Column) -> Column:
    return F.element_at(F.split(name, " "), 1)


def last_token(name: Column) -> Column:
    return F.element_at(F.split(name, " "), -1)


def normalize_email(text: Column) -> Column:
    return F.lower(trimmed(present(text)))


def normalize_phone(text: Column) -> Column:
    """E.164 by the rules of the North American plan for numbers without a country code or with +1; other
    numbers need the calling code of a country and 8 to 15 digits in all. An extension is left out.
    Anything else is null."""
    main = F.regexp_replace(text, EXTENSION, "")
    digits = F.regexp_replace(main, r"\D", "")
    abroad = trimmed(main).startswith("+") & ~digits.startswith("1")
    national = F.regexp_extract(digits, r"^1?([2-9]\d{2}[2-9]\d{6})$", 1)
    known = digits.rlike(rf"^(?:{COUNTRIES})\d{{4,}}$") & F.length(digits).between(8, 15)
    return F.when(abroad, F.when(known, F.concat(F.lit("+"), digits))).when(national != "", F.concat(F.lit("+1"), national))


def phone_last7(phone: Column) -> Column:
    digits = F.regexp_replace(phone, r"\D", "")
    return F.when(F.length(digits) >= 7, F.right(digits, F.lit(7)))


def normalize_postal(text: Column) -> Column:
    return F.regexp_replace(F.lower(trimmed(present(text))), r"\s+", "")


def street_number(address: Column) -> Column:
    """The number, with one letter at most, that a normalised address begins with."""
    return F.nullif(F.regexp_extract(address, r"^\s*(\d+[a-zA-Z]?)\b", 1), F.lit(""))


def soundex(text: Column) -> Column:
    """Soundex in which every letter without a code parts equal codes."""
    letters = F.nullif(F.regexp_replace(F.upper(text), "[^A-Z]", ""), F.lit(""))
    codes = F.regexp_replace(F.translate(letters, LETTERS, DIGITS), r"(.)\1+", "$1")
    return F.concat(F.substring(letters, 1, 1), F.rpad(F.replace(F.substring(codes, F.lit(2), F.length(codes)), F.lit("0"), F.lit("")), 3, "0"))


def phone_warnings(raw: Column, phone: Column) -> Column:
    return F.when(raw.isNotNull() & phone.isNull(), F.array(F.lit("UNPARSEABLE_PHONE"))).otherwise(F.array().cast("array<string>"))
