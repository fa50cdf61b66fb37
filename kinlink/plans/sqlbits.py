"""Pieces of DuckDB SQL from which the oracles are put together."""

from __future__ import annotations

from kinlink.functions import tables as T

W = r"\p{L}\p{N}_"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g'))"


def words(x: str, table: dict[str, str]) -> str:
    """Whole words of x replaced by table."""
    cases = " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in table.items())
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[{W}]+|[^{W}]+'), lambda t: case t {cases} else t end), '')"


def clean(x: str) -> str:
    folded = rf"regexp_replace(strip_accents(coalesce({x}, '')), '[^a-zA-Z0-9\s\-'']', ' ', 'g')"
    return f"lower({squeeze(folded)})"


def name(x: str) -> str:
    return squeeze(words(clean(x), T.NAME_WORDS))


def address(x: str, country: str = "''") -> str:
    table = T.ADDRESS_WORDS_SECOND
    base = f"case when lower({country}) like '%france%' then {words(clean(x), table | {'st': 'saint'})} else {words(clean(x), table | {'st': 'street'})} end"
    return squeeze(base)


def hyphens(x: str) -> str:
    """Without hyphens that have no word on one side."""
    beside = lambda at: f"regexp_matches(substr(s.x, {at}, 1), '^[{W}]$')"
    return f"(select coalesce(string_agg(case when substr(s.x, g.i, 1) = '-' and not (g.i > 1 and {beside('g.i - 1')} and {beside('g.i + 1')}) then ' ' else substr(s.x, g.i, 1) end, '' order by g.i), '') from (select {x} as x) s, lateral (select unnest(range(1, length(s.x) + 1)) as i) g)"


def tokens(x: str, least: int = 1) -> str:
    return f"list_filter(string_split({squeeze(f'coalesce({x}, {chr(39) * 2})')}, ' '), lambda t: length(t) >= {least})"


def ascii_tokens(x: str, least: int) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda t: length(t) >= {least})"


def jaccard(a: str, b: str, plus: str = "") -> str:
    return f"case when len({a}) > 0 and len({b}) > 0 then len(list_intersect({a}, {b})) / (len(list_distinct(list_concat({a}, {b})))::double{plus}) else 0.0 end"


def grams(x: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, length(coalesce({x}, '')) - {n - 2}), lambda i: substr(coalesce({x}, ''), i, {n})))"


def letters(table: dict[str, str]) -> str:
    """The keys of a table of letters as a character class."""
    return "".join(rf"\x{{{ord(c):04X}}}" for c in table)


#: Stands for the vowel that a consonant has unless a sign takes its place.
OPEN = "\ue000"


def roman(x: str) -> str:
    """Brahmic scripts in Latin letters, folded and in lower case; other texts only folded."""
    each = f"list_transform(range(1, length({x}) + 1), lambda i: substr({x}, i, 1))"
    moved = f"nfc_normalize(array_to_string(list_transform({each}, lambda c: case when unicode(c) between {0x0980} and {0x0D7F} then chr({0x0900} + (unicode(c) % 128)::int) else c end), ''))"
    opened = f"regexp_replace({moved}, '([{letters(T.CONSONANTS)}])', '\\1{OPEN}', 'g')"
    closed = f"regexp_replace({opened}, '{OPEN}([{letters(T.VOWEL_SIGNS)}{letters({T.VIRAMA: ''})}])', '\\1', 'g')"
    table = T.OTHER_SIGNS | T.VOWEL_SIGNS | T.VOWELS | T.CONSONANTS | {OPEN: "a"}
    cases = " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in table.items())
    latin = f"regexp_replace(array_to_string(list_transform(regexp_extract_all({closed}, '(?s).'), lambda c: case c {cases} else c end), ''), 'a+', 'a', 'g')"
    return f"lower(strip_accents(case when regexp_matches({x}, '[\\x{{0900}}-\\x{{0D7F}}]') then {latin} else {x} end))"


def given(x: str) -> str:
    return f"(case when {x} is null or {x} = 'nan' then '' else {x} end)"


def rom_name(x: str) -> str:
    return squeeze(words(clean(roman(given(x))), T.NAME_WORDS))


def second_name(x: str) -> str:
    return f"case when {name(given(x))} <> '' then {name(given(x))} else {rom_name(x)} end"


def second_address(x: str, country: str) -> str:
    return address(f"({roman(given(x))})", f"coalesce({country}, '')")


def common(a: str, b: str) -> str:
    """Length of the longest common subsequence of two columns of up to 120 characters, by the bits of a hugeint."""
    full = f"((1::hugeint << length({a})::int) - 1)"
    mask = f"coalesce(list_sum(list_transform(list_filter(range(0, length({a})), lambda i: substr({a}, i + 1, 1) = substr({b}, j, 1)), lambda i: 1::hugeint << i::int)), 0)::hugeint"
    masks = f"list_transform(range(1, length({b}) + 1), lambda j: {mask})"
    return f"(length({a}) - bit_count(list_reduce(list_prepend({full}, {masks}), lambda v, m: ((v + (v & m)) | (v & ({full} - m))) & {full})))"


def ratio(a: str, b: str) -> str:
    return f"case when {a} = {b} then 1.0::double when {a} = '' or {b} = '' then 0.0::double else 2 * {common(a, b)} / (length({a}) + length({b}))::double end"


def kernels(pairs: str) -> str:
    """CTEs that end in sim: a, b, ratio, sort_ratio, set_ratio, jaro_winkler of the distinct pairs (a, b) that a query gives."""
    own = lambda x: f"list_filter(string_split_regex({x}, '[\\s\\p{{Z}}]+'), lambda t: t <> '')"
    joined = lambda x: f"array_to_string(list_sort({x}), ' ')"
    return f"""k0 as materialized (select distinct a, b from ({pairs})),
k1 as materialized (select a, b, {own("a")} as x, {own("b")} as y from k0),
k2 as materialized (select a, b, {joined("x")} as sa, {joined("y")} as sb, len(x) = 0 or len(y) = 0 as none, {joined("list_distinct(list_filter(x, lambda t: list_contains(y, t)))")} as shared,
  {joined("list_distinct(list_filter(x, lambda t: not list_contains(y, t)))")} as l, {joined("list_distinct(list_filter(y, lambda t: not list_contains(x, t)))")} as r from k1),
k3 as materialized (select a, b, sa, sb, none, shared, trim(shared || ' ' || l) as one, trim(shared || ' ' || r) as two from k2),
k4 as materialized (select a, b, {ratio("a", "b")} as ratio, {ratio("sa", "sb")} as sort_ratio, {ratio("one", "two")} as best, none, length(shared) as c, length(one) as m, length(two) as n, a = b as same from k3),
sim as materialized (select a, b, ratio, sort_ratio, case when none then 0.0::double when c = 0 then best else greatest(best, 2 * c / (c + least(m, n))::double) end as set_ratio,
  case when same then 1.0::double when a = '' or b = '' then 0.0::double else jaro_winkler_similarity(a, b) end as jaro_winkler from k4)"""


def portable(x: str) -> str:
    """The hash of a text by which rows are sampled and split: a number below 2**32."""
    return f"('0x' || substr(md5({x}), 1, 8))::bigint"


def numbers(x: str) -> str:
    return rf"list_filter(regexp_extract_all(coalesce({x}, ''), '[{W}]+'), lambda t: regexp_matches(t, '^\d+$'))"


def pairs(of: str, tag: str = "", ordered: bool = True) -> str:
    """The pairs of a list, as Spark's `pairs`."""
    a, b = f"({of})[i]", f"({of})[j]"
    both = f"'{tag}' || {a} || '|' || {b}" if ordered else f"'{tag}' || least({a}, {b}) || '|' || greatest({a}, {b})"
    return f"flatten(list_transform(range(1, len({of})::bigint + 1), lambda i: list_transform(range(i + 1, len({of})::bigint + 1), lambda j: {both})))"
