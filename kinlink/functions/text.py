"""Normalisers and extractors of names and addresses as Column expressions.

A word is what Python's \\w spans: letters, digits of any script and the underscore, no combining marks. Words are
rewritten by one pass that cuts a text into words and the rest and looks each word up, so a boundary means the same
in every engine. Null, empty and (where said) the text `nan` are the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinlink.functions import kernels
from kinlink.functions import tables as T
from kinlink.functions.kernels import accent_fold, mapped, nfc

W = r"\p{L}\p{N}_"
#: What Python's \s spans.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filled(c: str | Column, nan: bool = False) -> Column:
    c = F.coalesce(col(c), F.lit(""))
    return F.when(c == "nan", "").otherwise(c) if nan else c


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def rewritten(c: Column, words: dict[str, str]) -> Column:
    """Every whole word that words holds, replaced; all in one pass."""
    known = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    parts = F.regexp_extract_all(c, F.lit(f"[{W}]+|[^{W}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda t: F.coalesce(F.element_at(known, t), t)), "")


def has_legal(c: str | Column, dotted: bool = True) -> Column:
    """Whether a raw name holds a legal form as a whole word."""
    low = F.lower(filled(c))
    found = F.arrays_overlap(F.regexp_extract_all(low, F.lit(f"[{W}]+"), F.lit(0)), F.array(*map(F.lit, T.LEGAL_FORMS)))
    return found | (low.contains("sp") & low.rlike(f"(?<![{W}])(?:{T.LEGAL_FORM_DOTTED})(?![{W}])")) if dotted else found


def loose_hyphens(c: Column) -> Column:
    return F.regexp_replace(c, f"(?<![{W}])-|-(?![{W}])", " ")


def without_urls(c: Column) -> Column:
    return F.regexp_replace(c, r"https?://[^\s\p{Z}]+|www\.[^\s\p{Z}]+", " ")


def house_numbers(c: Column) -> Column:
    """`h.no` and `kh.no` in full."""
    c = F.regexp_replace(c, f"(?<![{W}])h\\.?no(?![{W}])", "house no")
    return F.regexp_replace(c, f"(?<![{W}])kh\\.?no(?![{W}])", "kh no")


def without_symbols(c: Column) -> Column:
    """Letters, digits, marks, blanks, hyphen and apostrophe stay."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}\p{M}\p{Zs}\-']", " ")


def name_first(c: str | Column) -> Column:
    """First generation, row-wise: composed, lower case, without URLs, abbreviations in full; marks of all scripts stay."""
    x = F.regexp_replace(rewritten(without_urls(F.lower(nfc(filled(c)))), T.NAME_WORDS), "&", "and")
    return squeezed(loose_hyphens(without_symbols(x)))


def address_first(c: str | Column) -> Column:
    x = rewritten(house_numbers(F.lower(nfc(filled(c)))), T.ADDRESS_WORDS_FIRST)
    x = F.regexp_replace(F.regexp_replace(x, "&", "and"), r"[,;|/\\]", " ")
    return squeezed(loose_hyphens(without_symbols(x)))


def name_columnwise(c: str | Column) -> Column:
    """First generation, column-wise: shorter lists, `&` spaced, no composition; combining marks are lost."""
    x = F.regexp_replace(rewritten(without_urls(F.lower(filled(c))), T.NAME_WORDS_SHORT), "&", " and ")
    return squeezed(loose_hyphens(F.regexp_replace(x, f"[^{W}\\s\\-']", " ")))


def address_columnwise(c: str | Column) -> Column:
    x = F.regexp_replace(rewritten(F.lower(filled(c)), T.ADDRESS_WORDS_SHORT), "&", " and ")
    x = F.regexp_replace(F.regexp_replace(x, r"[,;|/\\]", " "), f"[^{W}\\s\\-]", " ")
    return squeezed(loose_hyphens(x))


def name_plain(c: str | Column) -> Column:
    """Second generation: folded, cleaned, abbreviations in full."""
    return mapped(kernels.plain_name, c)


def name_romanised(c: str | Column) -> Column:
    return mapped(kernels.roman_name, c)


def name_second(c: str | Column) -> Column:
    """The plain form, or the romanised one where nothing plain is left."""
    return mapped(kernels.second_name, c)


def address_second(c: str | Column, country: str | Column) -> Column:
    """Second generation; `st` is a saint in France and a street elsewhere."""
    return mapped(kernels.second_address, c, country)


def numbers(c: str | Column) -> Column:
    """Whole words of digits, in order, with leading zeros."""
    return F.filter(F.regexp_extract_all(filled(c), F.lit(f"[{W}]+"), F.lit(0)), lambda t: t.rlike(r"^\p{Nd}+$"))


def without_zeros(c: Column) -> Column:
    return F.regexp_replace(c, "^0+", "")


def primary_number(c: str | Column) -> Column:
    """The first number without leading zeros; `0` for zeros, empty without a number."""
    first = F.get(numbers(c), F.lit(0))
    return F.when(first.isNull(), "").when(without_zeros(first) == "", "0").otherwise(without_zeros(first))


def tokens(c: str | Column, least: int = 1) -> Column:
    return F.filter(F.split(squeezed(filled(c)), " "), lambda t: F.length(t) >= least)


def ascii_tokens(c: str | Column, least: int) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(filled(c)), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= least)


def numeric_tokens(c: str | Column) -> Column:
    return F.array_distinct(F.filter(tokens(c), lambda t: t.rlike(r"\p{Nd}")))


def acronym(c: str | Column) -> Column:
    """First letters of two to six words other than stop words, else empty."""
    words = F.filter(F.regexp_extract_all(filled(c, nan=True), F.lit("[a-zA-Z0-9]+"), F.lit(0)), lambda t: ~F.lower(t).isin(*T.ACRONYM_STOPS))
    return F.when(F.size(words).between(2, 6), F.lower(F.array_join(F.transform(words, lambda t: F.substring(t, 1, 1)), ""))).otherwise("")


def vowel_skeleton(c: str | Column) -> Column:
    """The first letter and the later consonants of a folded word."""
    w = F.regexp_replace(F.lower(accent_fold(filled(c, nan=True))), "[^a-z0-9]", "")
    return F.concat(F.substring(w, 1, 1), F.regexp_replace(w.substr(F.lit(2), F.length(w)), "[aeiou]", ""))


def domain_strip(c: str | Column, anywhere: bool = False) -> Column:
    """A name without leading #, without its top-level domain (at the end, or before any word boundary), camel case parted."""
    ends = f"(?![{W}])" if anywhere else "$"
    x = F.regexp_replace(F.regexp_replace(filled(c), "^#+", ""), f"(?i)\\.({'|'.join(T.DOMAINS)}){ends}", "")
    return F.trim(F.lower(F.regexp_replace(x, "([a-z])([A-Z])", "$1 $2")))


def soundex(c: str | Column) -> Column:
    return F.soundex(filled(c))
