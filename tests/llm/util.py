"""Small tables with the awkward cases that every operator must take."""

import random
import zlib

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def texts(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 60))) for _ in range(n)]


def awkward():
    """doc_id, text, lang, source: nulls, empties, repeats, long and odd texts."""
    rows = [(k, t, ("en", "fr")[k % 2], f"s{k % 4}") for k, t in enumerate(texts(40))]
    rows += [(100, None, "en", "s0"), (101, "", None, None), (102, " \t\n", "fr", "s1"), (103, "one two", "en", None), (104, "é😀 ßẞ İ 中文 " * 50, "fr", "s2")]
    rows += [(105, "word " * 30000, "en", "s3"), (106, "x" * 60000, None, "s3"), (None, "no id here at all", "en", "s0"), (None, None, None, None)]
    rows += [rows[3], rows[3], (107, rows[5][1], "en", "s9"), (108, rows[5][1].upper(), "en", "s9"), (109, "1234 " * 20, "en", "s1")]
    return rows


def documents(spark, rows):
    """With extra columns whose names operators might use themselves."""
    data = [(*r, "x", 1, "y", 2.0) for r in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, h string, size int, hashes string, score double")


def fold(doc_id, by):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % by
