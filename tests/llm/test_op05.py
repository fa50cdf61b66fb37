"""Language: held-out accuracy, probabilities that sum to one, awkward rows."""

from collections import defaultdict

import numpy as np

from kinlink.llm import op05_language as m
from tests.llm.util import awkward, documents, fold


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in m.op5_language(spark, sf).collect()}
    assert set(got) == set(truth) and all(got[i]["held_out"] == (fold(i, 4) == 2) for i in got)
    held = [i for i in got if got[i]["held_out"]]
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_words_are_counted_over_whole_texts(spark):
    rows = [(1, "a b a", "en", "s"), (2, "b\nb C", "en", "s"), (3, "a", "fr", "s"), (4, None, "fr", "s")]
    got = {(r["lang"], r["word"]): r["n"] for r in m.word_counts(documents(spark, rows).filter("text is not null")).collect()}
    assert got == {("en", "a"): 2, ("en", "b"): 3, ("en", "c"): 1, ("fr", "a"): 1}


def test_probabilities_of_seen_contexts_sum_to_one(spark):
    words = spark.createDataFrame([("en", w, n) for w, n in {"abba": 3, "abc": 2, "cab": 1, "bab": 4, "caa": 1}.items()], "lang string, word string, n long")
    model = m.Models(m.gram_counts(words).toArrow())
    letters = list("abc") + ["\x03"]
    keys = {}
    for c in letters:
        _, _, k, ctx = m.grams(["a" + c.replace("\x03", "")] if c != "\x03" else ["a"])
        keys[c] = (k[0][1], k[1][1])
    total = 0.0
    for one, two in keys.values():
        at, there = m.looked_up(model.keys[1], np.array([two]))
        if there[0]:
            total += np.exp(model.logs[1][at[0], 0])
        else:
            a1, _ = m.looked_up(model.keys[0], np.array([one]))
            ctx = m.grams(["ab"])[3][1][1]
            at, _ = m.looked_up(model.contexts[1], np.array([ctx]))
            total += np.exp(model.backs[1][at[0], 0] + model.logs[0][a1[0], 0])
    unseen = np.exp(model.backs[1][m.looked_up(model.contexts[1], np.array([m.grams(["ab"])[3][1][1]]))[0][0], 0] + model.unseen[0])
    assert abs(total + unseen - 1) < 1e-6


def by_definition(words, letters):
    """cost(word): the negative log probability of a word by interpolated Kneser-Ney over so many letters, straight from counted strings."""
    count = [defaultdict(int) for _ in range(m.ORDER + 1)]
    for w, n in words.items():
        t = f"\x02{w}\x03"
        for k in range(1, len(t)):
            for o in range(1, min(k + 1, m.ORDER) + 1):
                count[o][t[k - o + 1 : k + 1]] += n
    for o in range(1, m.ORDER):  # lower orders count the distinct letters to the left, but whole counts at a word's start
        left = defaultdict(set)
        for g in count[o + 1]:
            left[g[1:]].add(g[0])
        for g in count[o]:
            if g[0] != "\x02":
                count[o][g] = max(len(left[g]), 1)

    def p(context, c):
        o = len(context) + 1
        ones, twos = (sum(n == x for n in count[o].values()) for x in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        same = [n for g, n in count[o].items() if g[:-1] == context]
        lower = p(context[1:], c) if context else 1 / letters
        if not same:
            return lower
        own = count[o].get(context + c, 0)
        return (max(own - d, 0) if own else 0) / sum(same) + d * len(same) / sum(same) * lower

    def cost(word):
        t = f"\x02{word}\x03"
        return -sum(np.log(p(t[max(0, k - m.ORDER + 1) : k], t[k])) for k in range(1, len(t)))

    return cost


def test_costs_equal_the_definition(spark):
    rng = np.random.default_rng(4)
    word = lambda letters: "".join(rng.choice(list(letters), rng.integers(1, 9)))
    learnt = {lang: {word(letters): int(rng.integers(1, 5)) for _ in range(40)} for lang, letters in (("en", "abcd"), ("fr", "bcdeé"))}
    rows = [(lang, w, n) for lang, ws in learnt.items() for w, n in ws.items()]
    model = m.Models(m.gram_counts(spark.createDataFrame(rows, "lang string, word string, n long")).toArrow())
    tried = [word("abcdeéx") for _ in range(60)] + list(learnt["en"])[:20] + ["a", "zzz", "é"]
    cost, size = model.words(tried)
    assert size.tolist() == [len(w) + 1 for w in tried] and model.langs == ["en", "fr"]
    letters = len({c for ws in learnt.values() for w in ws for c in f"{w}\x03"}) + 1  # all models share the uniform floor
    for k, lang in enumerate(model.langs):
        want = by_definition(learnt[lang], letters)
        assert np.allclose(cost[:, k], [want(w) for w in tried])


def test_costs_of_one_language_equal_the_definition(spark):
    rng = np.random.default_rng(5)
    word = lambda letters: "".join(rng.choice(list(letters), rng.integers(1, 9)))
    for letters in ("ab", "abcd", "abcdefghij"):
        learnt = {word(letters): int(rng.integers(1, 5)) for _ in range(60)}
        model = m.Models(m.gram_counts(spark.createDataFrame([("en", w, n) for w, n in learnt.items()], "lang string, word string, n long")).toArrow())
        tried = [word(letters + "xy") for _ in range(80)] + list(learnt)
        want = by_definition(learnt, len({c for w in learnt for c in w}) + 2)
        assert np.allclose(model.words(tried)[0][:, 0], [want(w) for w in tried])


def test_awkward_rows(spark):
    rows = awkward()
    got = m.identify(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [by[k]["lang_pred"] for k in (100, 101, 102, 109)] == ["und"] * 4 and by[100]["score"] == 0
    assert by[103]["lang_pred"] in ("en", "fr")


def test_without_learnt_texts(spark):
    docs = documents(spark, [(1, "some text", None, "s"), (2, "more", None, "s")])
    assert {r["lang_pred"] for r in m.identify(docs).collect()} == {"und"}
    assert m.identify(docs.limit(0)).count() == 0
    assert m.Models(m.gram_counts(m.word_counts(docs.limit(0))).toArrow()).langs == []


def test_every_n_gram_has_its_own_entry(spark):
    rng = np.random.default_rng(1)
    words = sorted({"".join(map(chr, rng.integers(0x4E00, 0x9FA5, 4))) for _ in range(20_000)})
    counts = m.gram_counts(spark.createDataFrame([("zh", w, 1) for w in words], "lang string, word string, n long")).toPandas()
    want = {n: len({f"\x02{w}\x03"[k - n + 1 : k + 1] for w in words for k in range(max(n - 1, 1), 6)}) for n in range(1, m.ORDER + 1)}
    assert counts.groupby("o").size().to_dict() == want


def test_models_too_large_to_send_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = awkward()
    rows += [(1000 + k, " ".join("".join(map(chr, rng.integers(97 if k % 2 else 0x4E00, 123 if k % 2 else 0x4F00, rng.integers(1, 9)))) for _ in range(60)), ("zh", "fr")[k % 2], "s") for k in range(60)]
    docs = documents(spark, rows)

    def run():
        return sorted((tuple(r) for r in m.identify(docs).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2], r[3]))

    want = run()
    for cells in (600, 6000):  # a few n-grams are sent, or most
        monkeypatch.setattr(m, "CELLS", cells)
        got = run()
        assert [(r[0], r[1], r[2], r[5]) for r in got] == [(r[0], r[1], r[2], r[5]) for r in want]
        assert np.allclose([r[3] for r in got], [r[3] for r in want])
        assert np.allclose([np.nan if r[4] is None else r[4] for r in got], [np.nan if r[4] is None else r[4] for r in want], equal_nan=True)
