"""Batch kernels against textbook definitions, one pair at a time."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinlink.functions import kernels as k

WORD = st.text(alphabet="abc é中", max_size=14)
PAIRS = st.lists(st.tuples(WORD, WORD), max_size=12)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def ratio(a, b):
    return 1.0 if a == b else 2 * lcs(a, b) / (len(a) + len(b))


def sort_ratio(a, b):
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def set_ratio(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max(ratio(one, two), ratio(both, one), ratio(both, two)) if both else ratio(one, two)


def jaro_winkler(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach, used, mine = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, c in enumerate(a):
        for j, d in enumerate(b):
            if abs(i - j) <= reach and j not in used and c == d:
                used.add(j)
                mine.append(c)
                break
    if not mine:
        return 0.0
    m, turned = len(mine), sum(x != b[j] for x, j in zip(mine, sorted(used), strict=True)) // 2
    base = (m / len(a) + m / len(b) + (m - turned) / m) / 3
    prefix = 0
    while prefix < 4 and a[prefix : prefix + 1] == b[prefix : prefix + 1] != "":
        prefix += 1
    return base + prefix * 0.1 * (1 - base) if base > 0.7 else base


def grams(n):
    def jaccard(a, b):
        x, y = ({t[i : i + n] for i in range(len(t) - n + 1)} for t in (a, b))
        return len(x & y) / len(x | y) if x and y else 0.0

    return jaccard


DEFINED = {"c3": grams(3), "c4": grams(4), "ratio": ratio, "sort_ratio": sort_ratio, "set_ratio": set_ratio, "jaro_winkler": jaro_winkler}


def same(pairs):
    for kind, defined in DEFINED.items():
        for p, got in zip(pairs, k.KERNELS[kind](pairs), strict=True):
            assert abs(got - defined(*p)) < 1e-12, (kind, p)


@given(PAIRS)
@settings(max_examples=300, deadline=None)
def test_kernels_equal_their_definitions(pairs):
    same(pairs)


@pytest.mark.parametrize("length", [63, 64, 65, 127, 128, 129, 200, 520])
def test_lengths_around_words(length):
    rng = random.Random(length)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    pairs = [(text(length, "ab "), text(rng.randrange(length + 3), "ab ")) for _ in range(6)]
    pairs += [(text(rng.randrange(1, length), "abcdefg é"), text(length, "abcdefg é")) for _ in range(6)]
    pairs += [("a" * length, "a" * (length + 1)), ("", "a" * length), ("\x00" * 3, "\x00\x01"), ("😀" * length, "😀x" * 3), ("ýýýýaýýýý", "ýýýý"), ("\x00\x00\x00\x00", "\x00\x00\x00\x00\x01")]
    same(pairs)


def test_slices_keep_their_pairs(monkeypatch):
    monkeypatch.setattr(k, "SLICE", 3)
    rng = random.Random(2)
    same([("".join(rng.choice("abc ") for _ in range(rng.randrange(90))), "".join(rng.choice("abc ") for _ in range(rng.randrange(90)))) for _ in range(40)])


def test_known_values():
    jw, r, s = (lambda a, b, f=k.KERNELS[n]: f([(a, b)])[0] for n in ("jaro_winkler", "ratio", "set_ratio"))
    assert abs(jw("MARTHA", "MARHTA") - 0.9611) < 1e-4
    assert abs(jw("DIXON", "DICKSONX") - 0.8133) < 1e-4
    assert r("", "") == 1 and jw("", "") == 1 and s("", "") == 0
    assert s("new york mets", "new york mets vs atlanta braves") == 1
    assert abs(r("this is a test", "this is a test!") - 28 / 29) < 1e-12


def test_udf_takes_nulls(spark):
    df = spark.createDataFrame([("ab", None), (None, None), ("ab", "ab")], "a string, b string")
    got = df.select(k.similarities("a", "b").alias("s"), k.indel("a", "b").alias("i"), k.compared(x=("a", "b", "ratio"), y=("b", "a", "jaro_winkler")).alias("c")).collect()
    assert [r["i"] for r in got] == [0.0, 1.0, 1.0] == [r["c"]["x_ratio"] for r in got]
    assert [r["s"]["set_ratio"] for r in got] == [0.0, 0.0, 1.0]
    assert df.limit(0).select(k.similarities("a", "b").alias("s")).count() == 0
