"""Language of a text by interpolated Kneser-Ney character models.

A model for each language predicts the characters of lower-case words, the end included, from up to ORDER - 1
characters before. Words and their counts come from all learnt texts; n-grams, keyed by 64 bits, from the
distinct words. The highest order keeps counts, lower orders count distinct extensions to the left (whole counts
where nothing can stand to the left), each order has the absolute discount n1 / (n1 + 2 n2) and is interpolated
with the next. A text's words are looked up once for each distinct word of a batch. The lowest cross-entropy per
character wins.

The model grows with the corpus; no n-gram is dropped or merged. Counts are a written table. While they make at most
CELLS numbers (counts by languages), the models are sorted arrays, one for each order with a column for each language,
sent to the executors. Beyond, probabilities stay a written table, computed by joins from order to order; the n-grams
with the highest counts, CELLS / 2 numbers of them, are sent, and what texts have of others is joined by n-gram.

Calibration: per predicted language, the cross-entropies of the learnt rows give the quantile CALIBRATE; a text
above it by more than MARGIN is marked rejected, though its likeliest language is still reported.

Null texts and texts without a letter: `und`, score 0. Without any learnt text every text is `und`. Null lang: not
learnt from. Very long texts are judged whole, each in a group of its own. Ties go to the language first by code point.
Repeated rows: one result each. Empty tables: empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.common import bound_batches, remainder, spread, table, written

ORDER = 4
#: Numbers of a model that the driver takes and sends.
CELLS = 1 << 22
#: Distinct words that a task holds before it passes them on.
HELD = 100_000
CALIBRATE, MARGIN = 0.999, 0.5
#: Characters' worth of evidence at most that the score's posterior weighs.
EVIDENCE = 40
#: Characters of texts judged together, and distinct words scored at once.
GROUP, SLICE = 3_000_000, 20_000


def folded(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """word (number) and depth of each predicted character, and for n = 1 to ORDER its n-gram's key and its context's key; valid where depth >= n - 1."""
    text = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    start = np.repeat(np.cumsum(size) - size, size)
    depth = np.arange(len(text)) - start
    word = np.repeat(np.arange(len(words)), size)
    rolled, keys, contexts = np.zeros(len(text), np.uint64), [], []
    with np.errstate(over="ignore"):
        for n in range(1, ORDER + 1):
            back = np.zeros(len(text), np.uint64)
            back[n - 1 :] = text[: len(text) - n + 1]
            before = np.zeros(len(text), np.uint64)
            before[1:] = rolled[:-1]
            rolled = folded(rolled * np.uint64(0x9E3779B97F4A7C15) + back + np.uint64(n))
            keys.append(rolled)
            contexts.append(before)
    told = depth > 0  # the mark itself is not predicted
    return word[told], depth[told], [k[told].astype(np.int64) for k in keys], [c[told].astype(np.int64) for c in contexts]


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n over whole texts; each task sums before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(k, w, n) for k, c in held.items() for w, n in c.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(text.lower().split())
            if sum(map(len, held.values())) > HELD:
                yield out()
        yield out()

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """lang, o (order), key, suffix, context, head (nothing stands to the left), n."""
    schema = "lang string, o int, key long, suffix long, context long, head boolean, n long"

    def counted(lang: str, words: list[str], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        word, depth, keys, contexts = grams(words)
        for n in range(1, ORDER + 1):
            at = np.flatnonzero(depth >= n - 1)
            key, first, where = np.unique(keys[n - 1][at], return_index=True, return_inverse=True)
            total = np.bincount(where, weights=counts[word[at]]).astype(np.int64)
            suffix = keys[n - 2][at][first] if n > 1 else np.zeros(len(key), np.int64)
            cols = [pa.array([lang] * len(key), pa.string()), pa.array(np.full(len(key), n, np.int32)), pa.array(key), pa.array(suffix), pa.array(contexts[n - 1][at][first]), pa.array(depth[at][first] == n - 1), pa.array(total)]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "o", "key", "suffix", "context", "head", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, rows in held.items():
                yield from counted(lang, [w for w, _ in rows], np.array([n for _, n in rows], dtype=np.float64))
            held.clear()

        for b in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(lang, []).append((word, n))
            if sum(map(len, held.values())) > HELD // 2:
                yield from out()
        yield from out()

    each = words.select("lang", "word", "n").mapInArrow(run, schema)
    return each.groupBy("lang", "o", "key").agg(F.min("suffix").alias("suffix"), F.min("context").alias("context"), F.min("head").alias("head"), F.sum("n").alias("n"))


def looked_up(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted array, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Models:
    """Sorted arrays of n-gram keys with log probabilities (one column for each language) and weights of the lower order by context."""

    def __init__(self, counts: pa.Table):
        """counts: lang, o, key, suffix, context, head, n as gram_counts gives them."""
        names = counts["lang"].combine_chunks().dictionary_encode() if counts.num_rows else pa.array([], pa.string()).dictionary_encode()
        self.langs = sorted(names.dictionary.to_pylist())
        width = len(self.langs)
        self.keys, self.logs, self.contexts, self.backs = [], [], [], []
        self.unseen = np.zeros(width)
        if not width:
            return
        turn = np.array([self.langs.index(x) for x in names.dictionary.to_pylist()])
        lang = turn[names.indices.to_numpy()]
        o, key_of, suffix_of, context_of, head_of, n_of = (counts[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("o", "key", "suffix", "context", "head", "n"))
        for n in range(1, ORDER + 1):
            at_n = o == n
            keys, first = np.unique(key_of[at_n], return_index=True)
            suffix, context = suffix_of[at_n][first], context_of[at_n][first]
            ctx = np.unique(context_of[at_n])
            prob, back = np.zeros((len(keys), width)), np.ones((len(ctx), width))
            for k in range(width):
                own = at_n & (lang == k)
                c = n_of[own].astype(np.float64)
                if n < ORDER:
                    shared, many = np.unique(suffix_of[(o == n + 1) & (lang == k)], return_counts=True)
                    place, there = looked_up(shared, key_of[own])
                    kinds = many[place] * there if len(many) else np.zeros(len(c))
                    c = np.where(head_of[own], c, np.maximum(kinds, 1))
                ones, twos = (c == 1).sum(), (c == 2).sum()
                d = ones / (ones + 2 * twos) if ones and twos else 0.5
                place = np.searchsorted(ctx, context_of[own])
                total = np.bincount(place, weights=c, minlength=len(ctx))
                kinds = np.bincount(place, minlength=len(ctx))
                have = total > 0
                back[have, k] = d * kinds[have] / total[have]
                prob[np.searchsorted(keys, key_of[own]), k] = np.maximum(c - d, 0) / total[place]
            if n == 1:
                letters = len(keys) + 1
                self.unseen = np.log(back[0] / letters)
                prob += back[0] / letters
            else:
                at, there = looked_up(self.keys[-1], suffix)
                lower = np.where(there[:, None], np.exp(self.logs[-1][at]), 1e-9)
                prob += back[np.searchsorted(ctx, context)] * lower
            self.keys.append(keys)
            self.logs.append(np.log(np.maximum(prob, 1e-12)))
            self.contexts.append(ctx)
            self.backs.append(np.log(np.maximum(back, 1e-12)))

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word the sum of negative log probabilities by language, and its number of predicted characters."""
        word, depth, keys, contexts = grams(words)
        at, there = looked_up(self.keys[0], keys[0])
        logs = np.where(there[:, None], self.logs[0][at], self.unseen)
        for n in range(2, ORDER + 1):
            at, there = looked_up(self.keys[n - 1], keys[n - 1])
            there &= depth >= n - 1
            ctx, known = looked_up(self.contexts[n - 1], contexts[n - 1])
            known &= (depth >= n - 1) & ~there
            logs[known] += self.backs[n - 1][ctx[known]]
            logs[there] = self.logs[n - 1][at[there]]
        size = np.array([len(w) + 1 for w in words])
        starts = np.cumsum(size) - size
        return -np.add.reduceat(logs, starts, axis=0), size

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and cross-entropy of each text; groups of texts of at most GROUP characters, or one longer text, are taken together."""
        langs, score, cross = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
        live = [k for k, t in enumerate(texts) if self.langs and t and any(map(str.isalpha, t))]
        group: list[int] = []
        held = 0
        for n, k in enumerate(live):
            group.append(k)
            held += len(texts[k])
            if n + 1 == len(live) or held + len(texts[live[n + 1]]) > GROUP:
                best, score[group], cross[group] = self.judged([texts[j] for j in group])
                for j, x in zip(group, best, strict=True):
                    langs[j] = self.langs[x]
                group, held = [], 0
        return langs, score, cross

    def judged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the best language, score and cross-entropy of texts with words. Equal words are scored once, in slices."""
        split = [t.lower().split() for t in texts]
        many = np.array([len(w) for w in split])
        codes, distinct = pd.factorize(np.array([w for words in split for w in words], dtype=object))
        del split
        parts = [self.words(list(distinct[at : at + SLICE])) for at in range(0, len(distinct), SLICE)]
        cost, size = np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts])
        starts = np.cumsum(many) - many
        total, chars = np.add.reduceat(cost[codes], starts, axis=0), np.add.reduceat(size[codes], starts)
        return settled(total, chars)


def settled(total: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the best language, score and cross-entropy from costs by language and predicted characters."""
    mean = total / chars[:, None]
    best = mean.argmin(axis=1)
    low = mean[np.arange(len(mean)), best]
    post = 1 / np.exp(-(mean - low[:, None]) * np.minimum(chars, EVIDENCE)[:, None]).sum(axis=1)
    return best, post, low


def counted_grams(docs: DataFrame) -> DataFrame:
    """Written n-gram counts of the rows of docs with text; n-grams of rows without lang have a null lang."""
    return written(gram_counts(written(word_counts(docs.filter("text is not null")), "words")), "grams")


def probabilities(counts: DataFrame, others: DataFrame, langs: list[str]) -> DataFrame:
    """key, n, logs (by language) of each n-gram of counts and others that is the longest at some character; the numbers of Models, by joins.

    others has n-grams of texts that are not learnt. An n-gram meets its suffix and its context, which as many n-grams
    share as there are characters at most, so no join has a hot key.
    """
    spark = counts.sparkSession
    wider = counts.filter("o > 1").groupBy("lang", (F.col("o") - 1).alias("o"), F.col("suffix").alias("key")).agg(F.count("*").alias("kinds"))
    c = F.when((F.col("o") == ORDER) | F.col("head"), F.col("n")).otherwise(F.greatest(F.coalesce("kinds", F.lit(1)), F.lit(1))).cast("double")
    own = written(counts.join(wider, ["lang", "o", "key"], "left").select("lang", "o", "key", "context", c.alias("c")), "weights")
    ones, twos = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
    d = own.groupBy("lang", "o").agg(F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(0.5).alias("d"))
    d = F.broadcast(spark.createDataFrame(d.collect(), d.schema))  # ORDER rows for each language
    contexts = own.groupBy("lang", "o", "context").agg(F.sum("c").alias("total"), F.count("*").alias("kinds")).join(d, ["lang", "o"])
    contexts = written(contexts.select("lang", "o", "context", "total", "d", (F.col("d") * F.col("kinds") / F.col("total")).alias("back")), "contexts")
    seen = own.join(contexts, ["lang", "o", "context"]).select("lang", "o", "key", (F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("seen"))
    seen = written(seen, "seen")
    every = counts.union(others).groupBy("o", "key").agg(F.min("suffix").alias("suffix"), F.min("context").alias("context"), F.min("head").alias("head"), F.sum("n").alias("n"), (F.count("lang") > 0).alias("learnt"))
    every = written(every, "every")
    letters = counts.filter("o = 1").select("key").distinct().count() + 1
    lower = {r["lang"]: r["back"] / letters for r in contexts.filter("o = 1").collect()}  # order 1 has one context
    flat = spark.createDataFrame([(lang, float(lower[lang])) for lang in langs], "lang string, lower double")
    p, ends = None, []
    for n in range(1, ORDER + 1):
        at = every.filter(F.col("o") == n).drop("o")
        if n == 1:
            at = at.crossJoin(F.broadcast(flat)).withColumn("back", F.lit(1.0))
        else:
            back = contexts.filter(F.col("o") == n).select("lang", "context", "back")
            at = at.join(p.select(F.col("key").alias("suffix"), "lang", F.col("p").alias("lower")), "suffix").join(back, ["lang", "context"], "left")
        at = at.join(seen.filter(F.col("o") == n).drop("o"), ["lang", "key"], "left")
        at = at.withColumn("p", F.coalesce("seen", F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * F.col("lower"))
        p = written(at.select("key", "lang", "head", "n", F.when(F.col("learnt"), F.greatest("p", F.lit(1e-12))).otherwise(F.col("p")).alias("p")), "order")
        if n > 1:
            ends.append(p if n == ORDER else p.filter("head"))
    found = ends[0]
    for end in ends[1:]:
        found = found.union(end)
    rows = F.sort_array(F.collect_list(F.struct("lang", F.log("p").alias("log"))))  # by code point, as langs
    return written(found.groupBy("key").agg(F.max("n").alias("n"), rows.alias("rows")).select("key", "n", F.col("rows.log").alias("logs")), "model")


def predicted_by_join(docs: DataFrame, model: DataFrame, langs: list[str]) -> DataFrame:
    """As predicted, from the table of probabilities."""
    width = len(langs)
    top = model.orderBy(F.desc("n"), "key").limit(CELLS // 2 // width).select("key", "logs").toArrow().combine_chunks()
    key, logs = top["key"].to_numpy(), top["logs"].combine_chunks().flatten().to_numpy().reshape(-1, width) if top.num_rows else np.zeros((0, width))
    order = np.argsort(key)
    shared = docs.sparkSession.sparkContext.broadcast((key[order], logs[order]))

    def costs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cost by language and predicted characters of each text, and text, key, n of the n-grams that were not sent."""
        split = [t.lower().split() for t in texts]
        many = np.array([len(w) for w in split])
        codes, distinct = pd.factorize(np.array([w for words in split for w in words], dtype=object))
        known, logs = shared.value
        cost, size, open_word, open_key = [], [], [], []
        for at in range(0, len(distinct), SLICE):
            words = list(distinct[at : at + SLICE])
            word, depth, keys, _ = grams(words)
            key = np.choose(np.minimum(depth, ORDER - 1), keys)
            place, there = looked_up(known, key)
            each = np.zeros((len(key), width))
            each[there] = logs[place[there]]
            n = np.array([len(w) + 1 for w in words])
            cost.append(-np.add.reduceat(each, np.cumsum(n) - n, axis=0))
            size.append(n)
            open_word.append(word[~there] + at)
            open_key.append(key[~there])
        starts = np.cumsum(many) - many
        total, chars = np.add.reduceat(np.concatenate(cost)[codes], starts, axis=0), np.add.reduceat(np.concatenate(size)[codes], starts)
        open_word, open_key = np.concatenate(open_word), np.concatenate(open_key)
        left = np.bincount(open_word, minlength=len(distinct))  # words come in order, so those of one lie together
        n = left[codes]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found = pd.DataFrame({"text": np.repeat(np.repeat(np.arange(len(texts)), many), n), "key": open_key[np.repeat((np.cumsum(left) - left)[codes], n) + step]})
        found = found.groupby(["text", "key"]).size().reset_index(name="n")
        return total, chars, found["text"].to_numpy(), found["key"].to_numpy(), found["n"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        names = ["row", "doc_id", "key", "n", "cost"]
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows = np.arange(row, row + len(texts))
            row += len(texts)
            live = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
            dead = sorted(set(range(len(texts))) - set(live))
            yield pa.RecordBatch.from_arrays([pa.array(rows[dead]), pa.array([ids[k] for k in dead], pa.int64()), pa.nulls(len(dead), pa.int64()), pa.nulls(len(dead), pa.int64()), pa.nulls(len(dead), pa.list_(pa.float64()))], names=names)
            group: list[int] = []
            held = 0
            for j, k in enumerate(live):
                group.append(k)
                held += len(texts[k])
                if j + 1 == len(live) or held + len(texts[live[j + 1]]) > GROUP:
                    total, chars, text, key, n = costs([texts[i] for i in group])
                    yield pa.RecordBatch.from_arrays([pa.array(rows[group]), pa.array([ids[i] for i in group], pa.int64()), pa.nulls(len(group), pa.int64()), pa.array(chars.astype(np.int64)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=names)
                    yield pa.RecordBatch.from_arrays([pa.array(rows[group][text]), pa.nulls(len(text), pa.int64()), pa.array(key), pa.array(n.astype(np.int64)), pa.nulls(len(text), pa.list_(pa.float64()))], names=names)
                    group, held = [], 0

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cost = b.column(2).to_pylist()
            live = [k for k, c in enumerate(cost) if c is not None]
            lang, score, cross = ["und"] * len(cost), np.zeros(len(cost)), np.full(len(cost), np.nan)
            if live:
                best, score[live], cross[live] = settled(np.array([cost[k] for k in live]), np.array(b.column(1).to_pylist(), dtype=object)[live].astype(np.float64))
                for k, x in zip(live, best, strict=True):
                    lang[k] = langs[x]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(cross, from_pandas=True)], names=["doc_id", "lang_pred", "score", "cross_entropy"])

    bound_batches(docs.sparkSession)
    each = spread(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", "text").mapInArrow(run, "row long, doc_id long, key long, n long, cost array<double>")
    each = written(each, "costs")
    rest = each.filter("key is not null").select("row", "key", F.col("n").alias("times")).join(model.select("key", "logs"), "key")
    rest = rest.groupBy("row").agg(F.array(*[F.sum(F.col("times") * F.col("logs")[k]) for k in range(width)]).alias("rest"))
    whole = F.when(F.col("rest").isNull(), F.col("cost")).otherwise(F.zip_with("cost", "rest", lambda a, b: a - b))
    return each.filter("key is null").join(rest, "row", "left").select("doc_id", "n", whole.alias("cost")).mapInArrow(last, "doc_id long, lang_pred string, score double, cross_entropy double")


def predicted(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, score, cross = shared.value.texts(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(cross, from_pandas=True)], names=["doc_id", "lang_pred", "score", "cross_entropy"])

    bound_batches(docs.sparkSession)
    return spread(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, cross_entropy double")


def identify(docs: DataFrame, held_out: int = 2, folds: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected."""
    bound_batches(docs.sparkSession)
    learnt = (remainder("doc_id", folds) != held_out) & F.col("lang").isNotNull()
    counts = counted_grams(docs.filter(learnt))
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if counts.count() * len(langs) <= CELLS:
        out = predicted(docs, Models(counts.toArrow()))
    else:
        others = counted_grams(docs.filter(~learnt).withColumn("lang", F.lit(None).cast("string")))
        out = predicted_by_join(docs, probabilities(counts, others, langs), langs)
    out = written(out, "languages")
    out = out.withColumn("held_out", remainder("doc_id", folds) == held_out)
    usual = out.filter("not held_out and cross_entropy is not null").groupBy("lang_pred").agg(F.percentile_approx("cross_entropy", CALIBRATE).alias("usual"))
    return out.join(F.broadcast(usual), "lang_pred", "left").select(  # one row for each learnt language
        "doc_id", "held_out", "lang_pred", "score", "cross_entropy", F.coalesce(F.col("cross_entropy") > F.col("usual") + MARGIN, F.lit(True)).alias("rejected")
    )


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
