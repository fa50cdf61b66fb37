"""Blocking keys of an entity as arrays of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinlink.functions import tables as T
from kinlink.functions.text import acronym, ascii_tokens, domain_strip, filled, numbers, tokens, without_zeros



def empty() -> Column:
    return F.array().cast("array<string>")


def gathered(*parts: Column) -> Column:
    """Distinct keys of arrays; null keys are dropped."""
    return F.array_distinct(F.filter(F.concat(*[F.coalesce(p, empty()) for p in parts]), lambda k: k.isNotNull()))


def pairs(of: Column, tag: str = "", sort: bool = False) -> Column:
    """tag and `a|b` for each a that stands before b; sort puts the smaller first."""

    def second(a: Column, i: Column) -> Column:
        rest = F.slice(of, i + 2, F.greatest(F.size(of) - i - 1, F.lit(0)))
        return F.transform(rest, lambda b: F.concat(F.lit(tag), F.least(a, b) if sort else a, F.lit("|"), F.greatest(a, b) if sort else b))

    return F.flatten(F.transform(of, second))


def one(c: Column, when: Column) -> Column:
    return F.when(when, F.array(c)).otherwise(empty())


def longest(of: Column, n: int) -> Column:
    """The n longest, earlier first among equals."""
    ranked = F.array_sort(F.transform(of, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t"))))
    return F.transform(F.slice(ranked, 1, n), lambda r: r["t"])


# first generation ---------------------------------------------------------------------------------------------


def v1_pairs(name: Column) -> Column:
    return pairs(F.array_sort(F.array_distinct(tokens(name, 2))))


def v1_bag(name: Column) -> Column:
    own = F.array_sort(F.array_distinct(tokens(name, 2)))
    return one(F.array_join(F.slice(own, 1, 6), "|"), F.size(own) > 0)


def v1_prefix(name: Column) -> Column:
    top = F.get(longest(tokens(name, 2), 1), F.lit(0))
    return one(F.concat(F.lit("pfx:"), F.substring(top, 1, 4)), F.coalesce(F.length(top) >= 4, F.lit(False)))


def v1_tokens(name: Column) -> Column:
    return F.transform(tokens(name, 2), lambda t: F.concat(F.lit("tok:"), t))


def v1_number(address: Column) -> Column:
    first = F.get(F.filter(tokens(address), lambda t: t.rlike(r"\p{Nd}")), F.lit(0))
    return one(F.concat(F.lit("num:"), first), first.isNotNull())


def v1_address(address: Column) -> Column:
    top = F.array_sort(longest(tokens(address, 4), 2))
    return F.when(F.size(top) == 2, F.array(F.concat(F.lit("adr:"), F.array_join(top, "|")))).when(F.size(top) == 1, F.array(F.concat(F.lit("adr1:"), F.get(top, F.lit(0))))).otherwise(empty())


def v1_keys(name: Column, address: Column, raw: Column | None = None) -> Column:
    """All first-generation keys; raw adds those of the domain-stripped raw name where its tokens differ."""
    parts = [v1_pairs(name), v1_bag(name), v1_prefix(name), v1_tokens(name), v1_number(address), v1_address(address)]
    if raw is not None:
        bare = domain_strip(raw)
        extra = F.concat(v1_pairs(bare), v1_bag(bare), v1_tokens(bare))
        parts.append(F.when(tokens(bare, 2) != tokens(name, 2), extra).otherwise(empty()))
    return gathered(*parts)


# second generation --------------------------------------------------------------------------------------------


def v2_names(name: Column) -> Column:
    own = ascii_tokens(name, 2)
    return F.when(F.size(own) == 1, F.array(F.concat(F.lit("tok1:"), F.get(own, F.lit(0))))).otherwise(pairs(F.slice(own, 1, 5), "tok2:", sort=True))


def v2_romanised(name: Column, roman: Column, shared: bool = False) -> Column:
    """Keys of a romanised name that differs; shared puts its pairs in the name's own space, so that scripts meet."""
    own, rom = ascii_tokens(name, 2), ascii_tokens(roman, 2)
    more = F.transform(F.filter(F.slice(rom, 1, 3), lambda t: F.length(t) >= 3), lambda t: F.concat(F.lit("tr1:"), t))
    keys = F.concat(pairs(F.slice(rom, 1, 4), "tok2:" if shared else "tr2:", sort=True), more)
    return F.when((F.size(rom) > 0) & (rom != own), keys).otherwise(empty())


def v2_acronym(raw: Column, query: bool) -> Column:
    """The acronym of the raw name; of a query also its words in capitals."""
    own = one(F.concat(F.lit("acro:"), acronym(raw)), acronym(raw) != "")
    if not query:
        return own
    spelt = F.regexp_extract_all(filled(raw), F.lit(r"(?<![\p{L}\p{N}_])[A-Z]{2,6}(?![\p{L}\p{N}_])"), F.lit(0))
    return F.concat(own, F.transform(spelt, lambda w: F.concat(F.lit("acro:"), F.lower(w))))


def address_tokens(address: Column) -> Column:
    return F.filter(ascii_tokens(address, 3), lambda t: ~t.isin(*T.GENERIC_ADDRESS))


def v2_numbers(raw_address: Column, address: Column, name: Column, roman: Column) -> Column:
    """Two numbers of the address with three of its words, and with the first word of the name."""
    nums = F.slice(F.filter(F.transform(numbers(raw_address), without_zeros), lambda n: F.length(n) >= 2), 1, 2)
    own, rom, words = ascii_tokens(name, 2), ascii_tokens(roman, 2), F.slice(address_tokens(address), 1, 3)
    streets = F.flatten(F.transform(nums, lambda n: F.transform(words, lambda a: F.concat(F.lit("na:"), n, F.lit("|"), a))))
    firsts = F.concat(F.slice(own, 1, 1), F.when(rom != own, F.slice(rom, 1, 1)).otherwise(empty()))
    return F.concat(streets, F.flatten(F.transform(nums, lambda n: F.transform(firsts, lambda t: F.concat(F.lit("nn:"), n, F.lit("|"), t)))))


def v2_addresses(address: Column) -> Column:
    return pairs(F.slice(address_tokens(address), 1, 4), "adr2:", sort=True)


def v2_grams(name: Column, roman: Column) -> Column:
    words = F.filter(F.concat(F.slice(ascii_tokens(name, 2), 1, 2), F.slice(ascii_tokens(roman, 2), 1, 2)), lambda t: F.length(t) >= 4)
    return F.flatten(F.transform(words, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 3), lambda i: F.concat(F.lit("g4:"), t.substr(i, F.lit(4))))))


def v2_keys(raw_name: Column, raw_address: Column, name: Column, address: Column, roman: Column, query: bool, shared: bool = False) -> Column:
    """All second-generation keys; an empty romanised name counts as the name."""
    roman = F.when(filled(roman) == "", name).otherwise(roman)
    return gathered(
        v2_names(name), v2_romanised(name, roman, shared), v2_acronym(raw_name, query), v2_numbers(raw_address, address, name, roman), v2_addresses(address), v2_grams(name, roman)
    )
