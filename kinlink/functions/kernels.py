"""String kernels that Spark has no function for, as Arrow UDFs that work on a whole batch of pairs at once.

ratio is the normalised indel similarity 2 * LCS / (m + n), LCS by bit parallelism: every pair of a slice takes one step
together, its bits in 64-bit words of a numpy array. Jaro-Winkler goes the same way. Texts beyond LONG characters take
Python's big integers instead, one pair at a time. Equal pairs of a batch are computed once, whatever field they are of.
All are marked nondeterministic so that a later filter on one of their fields does not run them twice.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kinlink.functions import tables as T

KINDS = ("ratio", "sort_ratio", "set_ratio", "jaro_winkler")
#: Longer texts are compared one pair at a time; pairs of a slice by the words of their bits.
LONG, SLICE = 512, 1 << 13
Pairs = Sequence[tuple[str, str]]
ONE, NONE = np.uint64(1), np.uint64(0)


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence of one pair."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    rows = full
    for c in b:
        if hit := at.get(c, 0) & rows:
            rows = ((rows + hit) | (rows - hit)) & full
    return len(a) - rows.bit_count()


def lengths(texts: Sequence[str]) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))


def points(texts: Sequence[str]) -> np.ndarray:
    """Code points from 2 on, text after text."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(2)


def slices(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Of pairs (arrays of strings) that need as many words for a: positions, lengths and codes of a, of b (most characters of b first), words.

    Codes have a row a text; a is filled up with 0, b with 1.
    """
    la, lb = lengths(a), lengths(b)
    words = np.maximum(-(-la // 64), 1)
    for w in np.unique(words).tolist():
        own = np.flatnonzero(words == w)
        own = own[np.argsort(-lb[own], kind="stable")]
        for k in range(0, len(own), max(1, SLICE // w)):
            at = own[k : k + max(1, SLICE // w)]
            flat = [points(x[at].tolist()) for x in (a, b)]
            top = max(int(f.max(initial=0)) for f in flat)
            kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32
            out = []
            for f, n, width, pad in zip(flat, (la[at], lb[at]), (w * 64, max(int(lb[at[0]]), 1)), (0, 1), strict=True):
                rows = np.full((len(at), width), pad, kind)
                rows[np.arange(width) < n[:, None]] = f.astype(kind)
                out += [n, rows]
            yield at, *out, w


def hits(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Bits of the positions of a that hold the row's character c."""
    return np.packbits(a == c[:, None], axis=1, bitorder="little").view(np.uint64)


def commons(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs."""
    x, y = np.array([*a, ""], object)[:-1], np.array([*b, ""], object)[:-1]
    la, lb = lengths(a), lengths(b)
    out = np.zeros(len(x), np.int64)
    for k in np.flatnonzero((np.maximum(la, lb) > LONG) & (np.minimum(la, lb) > 0)).tolist():
        out[k] = common(x[k], y[k])
    rest = np.flatnonzero((np.maximum(la, lb) <= LONG) & (np.minimum(la, lb) > 0))
    swap = (lb > la)[rest]  # the longer text lies in the words, so there are fewer steps
    for at, _, one, steps, two, words in slices(np.where(swap, y[rest], x[rest]), np.where(swap, x[rest], y[rest])):
        rows = np.full((len(at), words), ~NONE)
        for j in range(two.shape[1]):
            n = int(np.searchsorted(-steps, -j, side="left"))  # pairs whose shorter text is longer than j
            hit = hits(one[:n], two[:n, j])
            kept, add = rows[:n] & ~hit, rows[:n] & hit
            if words == 1:
                rows[:n] = (rows[:n] + add) | kept
            else:
                carry = np.zeros(n, np.uint64)
                for w in range(words):
                    s = rows[:n, w] + add[:, w]
                    t = s + carry
                    carry = ((s < add[:, w]) | (t < s)).astype(np.uint64)
                    rows[:n, w] = t | kept[:, w]
        out[rest[at]] = words * 64 - np.bitwise_count(rows).sum(axis=1, dtype=np.int64)
    return out


def ratios(pairs: Pairs) -> np.ndarray:
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    both = (lengths(a) + lengths(b)).astype(np.float64)
    return np.where(both > 0, 2 * commons(a, b) / np.maximum(both, 1), 1.0)


class Words(dict):
    """Of a text, remembered for a batch: its words in order, distinct and in order, as a set, and the distinct ones as a text."""

    def __missing__(self, text: str) -> tuple[list[str], list[str], set[str], str]:
        each = sorted(text.split())
        own = set(each)
        distinct = each if len(own) == len(each) else sorted(own)
        found = self[text] = (each, distinct, own, " ".join(distinct))
        return found


def sort_ratios(pairs: Pairs) -> np.ndarray:
    words = Words()
    return ratios([(" ".join(words[a][0]), " ".join(words[b][0])) for a, b in pairs])


def set_ratios(pairs: Pairs) -> np.ndarray:
    """The best ratio among the shared words and the shared words with either rest; 0 if a side has no word."""
    words, out, open_, lefts, rights, sizes = Words(), np.zeros(len(pairs)), [], [], [], []
    for k, (a, b) in enumerate(pairs):
        (_, x, sx, left), (_, y, sy, right) = words[a], words[b]
        if not x or not y:
            continue
        both, size = sx & sy, -1
        if both:
            if len(both) == len(x) or len(both) == len(y):
                out[k] = 1.0
                continue
            size = len(" ".join(both))
            left, right = " ".join([w for w in x if w not in both]), " ".join([w for w in y if w not in both])
        open_.append(k)
        lefts.append(left)
        rights.append(right)
        sizes.append(size)
    if open_:
        shared = np.array(sizes, np.float64)
        one, two = shared + 1 + lengths(lefts), shared + 1 + lengths(rights)  # the shared words and a blank stand before either rest
        best = 2 * (commons(lefts, rights) + shared + 1) / (one + two)
        alone = np.where(shared >= 0, 2 * shared / np.maximum(shared + np.minimum(one, two), 1), 0.0)  # the shared words against themselves with a rest
        out[open_] = np.maximum(best, alone)
    return out


def jaro(a: str, b: str) -> tuple[int, int, int]:
    """Matches, half transpositions and common prefix (to four characters) of one pair."""
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, mine = bytearray(len(b)), []
    for i, c in enumerate(a):
        at = b.find(c, max(0, i - reach), i + reach + 1)
        while at >= 0 and used[at]:
            at = b.find(c, at + 1, i + reach + 1)
        if at >= 0:
            used[at] = 1
            mine.append(c)
    theirs = [c for c, u in zip(b, used, strict=True) if u]
    prefix = next((k for k in range(4) if a[k : k + 1] != b[k : k + 1] or k >= len(a)), 4)
    return len(mine), sum(x != y for x, y in zip(mine, theirs, strict=True)), prefix


def jaros(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same of pairs, a row each; both texts of at most LONG characters and not empty."""
    out = np.zeros((len(a), 3), np.int64)
    # bits lie over the second text, steps go along the first
    for at, lb, two, la, one, words in slices(b, a):
        reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
        below = np.zeros((words * 64 + 1, words), np.uint64)  # the bits below a position
        for k in range(1, words * 64 + 1):
            below[k] = below[k - 1]
            below[k, (k - 1) // 64] |= ONE << np.uint64((k - 1) % 64)
        used, mine = np.zeros((len(at), words), np.uint64), np.zeros(one.shape, bool)
        for i in range(one.shape[1]):
            n = int(np.searchsorted(-la, -i, side="left"))
            window = below[np.minimum(i + reach[:n] + 1, words * 64)] & ~below[np.clip(i - reach[:n], 0, words * 64)]
            open_ = hits(two[:n], one[:n, i]) & window & ~used[:n]
            lowest = open_ & (~open_ + ONE)
            for w in range(1, words):
                lowest[(open_[:, :w] != 0).any(axis=1), w] = 0
            used[:n] |= lowest
            mine[:n, i] = (lowest != 0).any(axis=1)
        theirs = np.unpackbits(used.view(np.uint8), axis=1, bitorder="little").astype(bool)
        m = mine.sum(axis=1)
        differ = one[mine] != two[theirs]
        heads = min(4, one.shape[1], two.shape[1])
        prefix = np.logical_and.accumulate(one[:, :heads] == two[:, :heads], axis=1).sum(axis=1)
        out[at] = np.stack([m, np.bincount(np.repeat(np.arange(len(at)), m), weights=differ, minlength=len(at)).astype(np.int64), prefix], axis=1)
    return out


def jaro_winklers(pairs: Pairs) -> np.ndarray:
    """Jaro similarity, lifted by a common prefix of up to four characters where it is above 0.7."""
    a, b = (np.array([*(p[s] for p in pairs), ""], object)[:-1] for s in (0, 1))
    out, la, lb = (a == b).astype(np.float64), lengths(a), lengths(b)
    at = np.flatnonzero((out == 0) & (la > 0) & (lb > 0))
    counts, short = np.zeros((len(at), 3), np.int64), np.maximum(la, lb)[at] <= LONG
    counts[short] = jaros(a[at[short]], b[at[short]])
    for k in np.flatnonzero(~short).tolist():
        counts[k] = jaro(a[at[k]], b[at[k]])
    m, turned, prefix = counts.T
    base = np.where(m > 0, (m / la[at] + m / lb[at] + (m - turned // 2) / np.maximum(m, 1)) / 3, 0.0)
    out[at] = np.where(base > 0.7, base + prefix * 0.1 * (1 - base), base)
    return out


def distinct(grams: np.ndarray, many: np.ndarray, filler: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of at most so many n-grams in order, what repeats or is beyond them turned to filler; and how many are left."""
    grams[np.arange(grams.shape[1]) >= many[:, None]] = np.iinfo(grams.dtype).max
    grams.sort(axis=1)
    again = np.zeros(grams.shape, bool)
    again[:, 1:] = grams[:, 1:] == grams[:, :-1]
    again |= grams == np.iinfo(grams.dtype).max
    grams[again] = filler
    return grams, (~again).sum(axis=1)


def gram_jaccards(pairs: Pairs, n: int) -> np.ndarray:
    """Jaccard of the distinct n-grams, blanks included; 0 if a text is shorter than n. n is at most 4."""
    a, b = (np.array([*(p[s] for p in pairs), ""], object)[:-1] for s in (0, 1))
    la, lb = lengths(a), lengths(b)
    out, live = np.zeros(len(a)), np.flatnonzero((la >= n) & (lb >= n))
    live = live[np.argsort(np.maximum(la, lb)[live], kind="stable")]
    begin = 0
    while begin < len(live):
        # texts of a slice are about as long; the longest text comes last
        width = int(max(la[live[min(begin + SLICE, len(live)) - 1]], lb[live[min(begin + SLICE, len(live)) - 1]]))
        at = live[begin : begin + max(1, min(SLICE, (SLICE * 64) // width))]
        begin += len(at)
        flat = [points(x[at].tolist()) for x in (a, b)]
        top = max(int(f.max()) for f in flat)
        if top >= (1 << 16) - 1 or width > 1 << 16:
            for k in at.tolist():
                x, y = ({t[i : i + n] for i in range(len(t) - n + 1)} for t in (a[k], b[k]))
                out[k] = len(x & y) / len(x | y)
            continue
        bits, kind = (8, np.uint32) if top < (1 << 8) - 1 else (16, np.uint64)
        rows, counts = [], []
        for f, size, filler in zip(flat, (la[at], lb[at]), (0, 1), strict=True):
            wide = int(size.max())
            letters = np.zeros((len(at), wide), kind)
            letters[np.arange(wide) < size[:, None]] = f
            grams = letters[:, : wide - n + 1].copy()
            for k in range(1, n):
                grams = (grams << kind(bits)) | letters[:, k : wide - n + 1 + k]
            # codes start at 2, so 0 and 1 are no n-grams
            row, count = distinct(grams, size - n + 1, filler)
            rows.append(row)
            counts.append(count)
        merged = np.concatenate(rows, axis=1)
        merged.sort(axis=1)
        both = ((merged[:, 1:] == merged[:, :-1]) & (merged[:, 1:] > 1)).sum(axis=1)
        out[at] = both / (counts[0] + counts[1] - both)
    return out


KERNELS: dict[str, Callable[[Pairs], np.ndarray]] = dict(zip(KINDS, (ratios, sort_ratios, set_ratios, jaro_winklers), strict=True))
KERNELS |= {"c3": lambda pairs: gram_jaccards(pairs, 3), "c4": lambda pairs: gram_jaccards(pairs, 4)}


def scored(fields: Sequence[tuple[str, Pairs, Sequence[str]]]) -> dict[str, np.ndarray]:
    """`field_kind` for each field (name, pairs, kinds); a pair that several fields or rows hold is computed once a kind."""
    known: dict[tuple[str, str], int] = {}
    at = {name: np.fromiter((known.setdefault(p, len(known)) for p in pairs), np.int64, len(pairs)) for name, pairs, _ in fields}
    distinct, out = list(known), {}
    for kind in KERNELS:
        own = [name for name, _, kinds in fields if kind in kinds]
        if own:
            need = np.unique(np.concatenate([at[name] for name in own]))
            values = np.empty(len(distinct))
            values[need] = KERNELS[kind]([distinct[k] for k in need])
            out |= {f"{name}_{kind}": values[at[name]] for name in own}
    return out


def compared(**fields: tuple) -> Column:
    """Struct of `field_kind` doubles for fields of (column, column, *kinds), in one UDF; null counts as empty."""
    shape = [(name, f[2:] or KINDS) for name, f in fields.items()]
    names = [f"{name}_{kind}" for name, kinds in shape for kind in kinds]

    def run(*columns: pd.Series) -> pd.DataFrame:
        texts = [c.fillna("").tolist() for c in columns]
        out = scored([(name, list(zip(texts[2 * k], texts[2 * k + 1], strict=True)), kinds) for k, (name, kinds) in enumerate(shape)])
        return pd.DataFrame({n: out[n] for n in names})

    run.__annotations__ = {"columns": pd.Series, "return": pd.DataFrame}
    udf = F.pandas_udf(run, ", ".join(f"{n} double" for n in names)).asNondeterministic()
    return udf(*[c for f in fields.values() for c in f[:2]])


def similarities(a: str | Column, b: str | Column, *kinds: str) -> Column:
    """Struct of the named kernels (all of KINDS by default) of one pair of columns."""
    kinds = kinds or KINDS
    s = compared(s=(a, b, *kinds))
    return s.cast(f"struct<{', '.join(f'{k}: double' for k in kinds)}>")


def indel(a: str | Column, b: str | Column) -> Column:
    return compared(s=(a, b, "ratio"))["s_ratio"]


def fold(text: str) -> str:
    """Compatibility decomposition without combining marks."""
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def roman(text: str) -> str:
    """Brahmic scripts in Latin letters, folded, in lower case; other texts only folded."""
    if not any(0x0900 <= ord(c) <= 0x0D7F for c in text):
        return fold(text).lower()
    moved = "".join(chr(0x0900 + ord(c) % 0x80) if any(b <= ord(c) < b + 0x80 for b in T.BRAHMIC_BLOCKS) else c for c in text)
    out: list[str] = []
    bare = False  # whether a consonant still waits for its vowel
    for c in unicodedata.normalize("NFC", moved):
        if bare:
            if c in T.VOWEL_SIGNS or c == T.VIRAMA:
                out.append(T.VOWEL_SIGNS.get(c, ""))
                bare = False
                continue
            out.append("a")
        bare = c in T.CONSONANTS
        for letters in (T.CONSONANTS, T.VOWELS, T.VOWEL_SIGNS, T.OTHER_SIGNS):
            if c in letters:
                out.append(letters[c])
                break
        else:
            out.append(c)
    if bare:
        out.append("a")
    text = "".join(out)
    while "aa" in text:
        text = text.replace("aa", "a")
    return fold(text).lower()


def mapped(f: Callable[..., str | None], *columns: str | Column) -> Column:
    """f over strings. Nondeterministic, so that the optimiser keeps it in a step of its own, outside lambdas."""

    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([f(*row) for row in zip(*(x.tolist() for x in series), strict=True)], dtype=object)

    run.__annotations__ = {"series": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string").asNondeterministic()(*columns)


def accent_fold(c: str | Column) -> Column:
    return mapped(lambda x: None if x is None else fold(x), c)


def accent_fold_lower(c: str | Column) -> Column:
    """Null counts as empty."""
    return mapped(lambda x: fold(x or "").lower(), c)


def romanised(c: str | Column) -> Column:
    return mapped(lambda x: None if x is None else roman(x), c)


def nfc(c: str | Column) -> Column:
    return mapped(lambda x: None if x is None else unicodedata.normalize("NFC", x), c)


# second-generation normal forms: they need the folding above, so the rest is done in the same pass over a batch

_OTHER, _WORD = re.compile(r"[^a-zA-Z0-9\-']+"), re.compile("[a-z0-9]+")
#: `hno` and `khno` in full, beside the abbreviations.
HOUSE = {"hno": "house no", "khno": "kh no"}
ADDRESS = {french: T.ADDRESS_WORDS_SECOND | HOUSE | {"st": "saint" if french else "street"} for french in (False, True)}


def given(text: str | None) -> str:
    """Null and the text `nan` are the empty text."""
    return "" if text is None or text == "nan" else text


def cleaned(folded: str) -> str:
    """Of a folded text only ASCII letters, digits, hyphen and apostrophe, in lower case."""
    return _OTHER.sub(" ", folded).strip(" ").lower()


def rewritten(text: str, words: dict[str, str]) -> str:
    """Every whole word of a cleaned text that words holds, replaced."""
    if "-" in text or "'" in text:
        return _WORD.sub(lambda m: words.get(m[0], m[0]), text)
    return " ".join([words.get(t, t) for t in text.split(" ")])


def plain_name(text: str | None) -> str:
    return rewritten(cleaned(fold(given(text))), T.NAME_WORDS)


def roman_name(text: str | None) -> str:
    return rewritten(cleaned(roman(given(text))), T.NAME_WORDS)


def second_name(text: str | None) -> str:
    """The plain form, or the romanised one where nothing plain is left."""
    return plain_name(text) or roman_name(text)


def second_address(text: str | None, country: str | None) -> str:
    return rewritten(cleaned(roman(given(text))), ADDRESS["france" in (country or "").lower()])


def second_forms(name: str | Column, address: str | Column, country: str | Column) -> Column:
    """Struct of norm_name, rom_name and norm_addr in one UDF."""

    def run(names: pd.Series, addresses: pd.Series, countries: pd.Series) -> pd.DataFrame:
        rows = []
        for n, a, c in zip(names.tolist(), addresses.tolist(), countries.tolist(), strict=True):
            plain = plain_name(n)
            rows.append((plain or roman_name(n), plain if n is None or n.isascii() else roman_name(n), second_address(a, c)))
        return pd.DataFrame(rows, columns=["norm_name", "rom_name", "norm_addr"], dtype=object)

    run.__annotations__ = {"names": pd.Series, "addresses": pd.Series, "countries": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "norm_name string, rom_name string, norm_addr string").asNondeterministic()(name, address, country)
