r"""Near copies by MinHash bands, odd sketches and full sets.

A document's set is its distinct shingles of WORDS words. Equal sets form one class, and only classes are compared.
A class has HASHES MinHash samples; BANDS bands of them post it in buckets. Its odd sketch folds the samples into a
parity bitmap: the count of bits in the XOR of two sketches estimates the Jaccard similarity, most precisely where
it is high. A second bitmap folds the whole set; the XOR of two of those never holds more bits than the sets differ
in, so it refutes a link for certain. What passes both is confirmed on the full sets.

Buckets are worked off without pairing everything in them. A round compares one hub of each bucket with the members
outside its component, then leaves the hub out; a bucket whose members are one component is done. Buckets still
open after STARS rounds are compared in blocks of BLOCK sketches, each pair of blocks in some task. Every pair of
classes that shares a bucket is thus compared or already in one component; no bucket is capped.

Texts with fewer than WORDS words are one shingle. Null or empty texts, or such without words, have empty sets
and are linked with nothing. Rows with a null doc_id get a null component and are kept. Rows that share a doc_id
are one node, whatever their texts. Very long texts are read whole; a worker holds some thirty times the bytes of the
longest one. Repeated rows: one result each. Empty tables: empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.common import bound_batches, spread, table, written
from kinlink.llm.graph import components

WORDS, NUM, DEN = 5, 75, 100
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Bits of the odd sketch of the samples, and of the bitmap of the whole set.
ODD, WHOLE = 512, 2048
#: Deviations by which an estimate may miss before a pair is dropped.
SIGMAS = 6.0
STARS, BLOCK = 3, 256
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


@lru_cache(maxsize=1)
def constants() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(20240229)
    base = 0x9E3779B97F4A7C15 | 1
    return {
        "byte": rng.integers(0, 2**64, 256, dtype=np.uint64),
        "blank": np.isin(np.arange(256), [9, 10, 11, 12, 13, 32]),
        "place": rng.integers(0, 2**64, WORDS, dtype=np.uint64) | U(1),
        "a": (rng.integers(0, 2**32, HASHES, dtype=np.uint64) | U(1)).astype(np.uint32)[:, None],
        "b": rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None],
        "base": np.array([base, pow(base, -1, 2**64)], dtype=np.uint64),
    }


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            for k in (0, 1):
                steps = np.full(max(n, 1 << 16), constants()["base"][k])
                steps[0] = 1
                _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    data = np.frombuffer((text or "").encode().lower(), np.uint8)  # bytes.lower() changes A-Z only
    if not len(data):
        return np.empty(0, np.uint64)
    c = constants()
    seen = np.empty(len(data) + 2, bool)
    seen[0] = seen[-1] = False
    np.logical_not(c["blank"][data], out=seen[1:-1])
    turns = np.flatnonzero(seen[1:] != seen[:-1])
    starts, ends = turns[::2], turns[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(c["byte"][data] * up[: len(data)], out=sums[1:])
    word = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    width = min(WORDS, len(word))
    last = len(word) - width + 1
    out = np.full(last, width, np.uint64)
    for k in range(width):
        out = out + mixed(word[k : k + last] ^ c["place"][k]) * c["place"][k]
    return np.unique(mixed(out))


def samples(x: np.ndarray) -> np.ndarray:
    """MinHash samples of a set, in slices that stay in the cache."""
    c, x = constants(), (x >> U(32)).astype(np.uint32)
    out = np.full(HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(out, (x[None, at : at + 1024] * c["a"] + c["b"]).min(axis=1), out=out)
    return out


def parity(x: np.ndarray, bits: int) -> bytes:
    return np.packbits((np.bincount((x % U(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def signature(x: np.ndarray) -> tuple[list[int], bytes, bytes]:
    """Bucket keys, odd sketch of the samples, bitmap of the set."""
    m = samples(x).astype(np.uint64)
    tagged = mixed(m | (np.arange(HASHES, dtype=np.uint64) << U(32)))
    keys = mixed((tagged.reshape(BANDS, ROWS) * constants()["place"][:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return keys.view(np.int64).tolist(), parity(tagged, ODD), parity(mixed(x), WHOLE)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), cls (digest of the set, null if empty), bands, odd, whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                rows = []
                for t in b.column(1).to_pylist():
                    x = shingles(t)
                    rows.append((len(x), xxhash.xxh3_128_digest(x.tobytes()), *signature(x)) if len(x) else (0, None, None, None, None))
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(v), k) for v, k in zip(cols, kinds, strict=True))], names=["doc_id", "n", "cls", "bands", "odd", "whole"])

    bound_batches(docs.sparkSession)
    rows = spread(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, n long, cls binary, bands array<long>, odd binary, whole binary")


def sets_of(docs: DataFrame) -> DataFrame:
    """id and hashes, the full set of each document as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["id", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, hashes binary")


def bits(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1)


def possible(na, nb, odd: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Whether sets of na and nb elements may be linked, given the bits in which their sketches differ."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    ok = DEN * small >= NUM * large
    # elements in which linked sets can differ at most: (na + nb) * (1 - J) / (1 + J); a bitmap never shows more
    ok &= whole * (DEN + NUM) <= (na + nb) * (DEN - NUM)
    # a pair at the threshold differs in 2 * HASHES * (1 - J) folded samples on average; expected bits and their deviation
    j = NUM / DEN
    most = min(2 * HASHES * (1 - j) + SIGMAS * 2 * np.sqrt(HASHES * j * (1 - j)), 2 * HASHES)
    expected = ODD / 2 * (1 - np.exp(-2 * most / ODD))
    return ok & (odd <= expected + SIGMAS / 2 * np.sqrt(ODD) / 2)


def passing(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs a, b that their sketches do not refute."""
    side = lambda s: reps.select(F.col("rep").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "odd", "whole")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                col = {n: t.column(n) for n in t.schema.names}
                diff = {k: np.bitwise_count(bits(col[f"{k}_a"].to_pylist()) ^ bits(col[f"{k}_b"].to_pylist())).sum(axis=1, dtype=np.int64) for k in ("odd", "whole")}
                ok = possible(col["n_a"].to_numpy(), col["n_b"].to_numpy(), diff["odd"], diff["whole"])
                yield pa.RecordBatch.from_arrays([col["a"], col["b"]], names=["a", "b"]).filter(pa.array(ok))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose full sets are linked."""
    side = lambda s: sets.select(F.col("id").alias(s), F.col("hashes").alias(f"hashes_{s}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            for p, q in zip(t.column("hashes_a"), t.column("hashes_b"), strict=True):
                x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = len(x) + len(y)
                merged = np.concatenate([x, y])
                merged.sort(kind="stable")
                same = int((merged[1:] == merged[:-1]).sum())
                ok.append(DEN * same >= NUM * (both - same))
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def in_blocks(open_: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs of members of one bucket, of different components, that sketches do not refute; open_: key, rep, component."""
    each = open_.groupBy("key", "component").agg(F.count("*").alias("n"))
    sizes = each.groupBy("key").agg(F.max_by("component", "n").alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = written(sizes.select("key", "main", blocks(F.col("all") - F.col("most")).alias("rest"), blocks(F.col("most")).alias("inner")), "sizes")
    dealt = open_.join(sizes, "key").join(reps.select("rep", "n", "odd", "whole"), "rep")
    # members of a bucket's main component have blocks of their own, which meet only the blocks of the others
    inside, h = F.col("component") == F.col("main"), F.xxhash64("rep")
    own = F.when(inside, F.col("rest") + F.pmod(h, F.col("inner"))).otherwise(F.pmod(h, F.col("rest"))).cast("int")
    meets = F.when(inside, F.col("rest")).otherwise(F.col("rest") + F.col("inner"))
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), meets - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "component", "n", "odd", "whole")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def pairs(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        _, i, j = rows[0][:3]
        left = [r for r in rows if r[3] == i]
        right = left if i == j else [r for r in rows if r[3] == j]
        if not left or not right:
            return
        odd, whole = bits([r[7] for r in right]), bits([r[8] for r in right])
        ids, comp, n = (np.array([r[k] for r in right]) for k in (4, 5, 6))
        a, b = [], []
        for r in left:
            ok = possible(r[6], n, np.bitwise_count(odd ^ bits([r[7]])).sum(axis=1, dtype=np.int64), np.bitwise_count(whole ^ bits([r[8]])).sum(axis=1, dtype=np.int64))
            found = ids[ok & (comp != r[5]) & ((ids > r[4]) if i == j else True)]
            a += np.minimum(found, r[4]).tolist()
            b += np.maximum(found, r[4]).tolist()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for t in batches:
            for row in zip(*(c.to_pylist() for c in t.columns), strict=True):
                if group and group[0][:3] != row[:3]:
                    yield from pairs(group)
                    group = []
                group.append(row)
        if group:
            yield from pairs(group)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def linked(docs: DataFrame, reps: DataFrame, repeated: bool) -> DataFrame:
    """node and component of every class that is linked with another; reps: rep, n, bands, odd, whole. repeated: some doc_id has several rows.

    Classes with the same smallest doc_id have one rep, and so one node with several sets; any of them makes a link.
    """
    spark = docs.sparkSession
    posted = reps.select(F.explode("bands").alias("key"), "rep")
    # what is counted by bucket is written before it meets the members, so that a join deals both by key and a hot bucket can be split
    full = written(posted.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "full")
    members = written(posted.join(full, "key").select("key", "rep", F.col("rep").alias("component")), "members")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = sets_of(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi"))
    if repeated:  # else no set need be dealt again for it
        sets = sets.withColumn("digest", F.xxhash64("hashes")).dropDuplicates(["id", "digest"]).drop("digest")
    sets = written(sets, "sets")
    bound_batches(spark, 256)
    tested = found = None
    for turn in range(STARS + 1):
        if turn < STARS:
            # a hub of each open bucket meets the members outside its component
            hub = F.min_by(F.struct("rep", "component"), F.struct(F.xxhash64("rep", F.lit(turn)), "rep")) if turn else F.min(F.struct("rep", "component"))
            hubs = members.groupBy("key").agg(hub.alias("hub"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
            hubs = written(hubs.select("key", "hub"), "hubs")
            star = written(members.join(hubs, "key").select("key", "rep", "component", F.col("hub.rep").alias("hub"), F.col("hub.component").alias("of")).filter("rep <> hub"), "star")
            pairs = star.filter("component <> of").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
            members = star.select("key", "rep", "component")
        else:
            spread_out = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
            pairs = in_blocks(members.join(written(spread_out, "open"), "key").select("key", "rep", "component"), reps)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs, new = written(pairs, "pairs"), None
        if pairs.limit(1).count():
            new = written(confirmed(pairs if turn >= STARS else passing(pairs, reps), sets), "links")
            tested = pairs if tested is None else tested.union(pairs)
            if new.limit(1).count():
                found = components(new if found is None else new.union(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
            else:
                new = None
        elif turn < STARS and not members.limit(1).count():
            break
        if turn < STARS:
            # without a new link every member keeps its component
            if new is not None:
                at = found.withColumnRenamed("node", "rep")
                members = members.select("key", "rep").join(at, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
            members = written(members, "members")
    return found if found is not None else spark.createDataFrame([], "node long, component long")


def cluster(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    docs = spread(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", "text")
    each = written(signatures(docs), "signatures")
    named = each.filter("n > 0 and doc_id is not null")
    reps = named.groupBy("cls").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "bands", "odd", "whole")])
    reps = written(reps, "classes")
    repeated = bool(named.groupBy("doc_id").count().filter("count > 1").limit(1).count())
    found = linked(docs, reps.drop("cls"), repeated)
    # one doc_id with several texts is one node: its classes are tied through it
    each_of = named.select("doc_id", "cls").join(reps.select("cls", "rep"), "cls").select("doc_id", "rep")
    of = written(each_of.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("last")), "reps")
    several = of.filter("rep < last").select("doc_id", F.col("rep").alias("b"))
    if several.limit(1).count():
        ties = each_of.join(several, "doc_id").filter("rep <> b").select(F.col("rep").alias("a"), "b")
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(ties))
    of = of.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("c"))
    out = each.select("doc_id", "n").join(of, "doc_id", "left")
    component = F.coalesce("c", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept: one of each component; a doc_id that repeats stays once, null ids all stay."""
    gone = written(cluster(docs).filter("not kept").select("doc_id").distinct(), "gone")
    out = docs.join(gone, "doc_id", "left_anti")
    again = written(docs.groupBy("doc_id").count().filter("doc_id is not null and count > 1").select("doc_id"), "again")
    if again.limit(1).count():  # else no text need be dealt for it
        once = out.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        out = out.join(again, "doc_id", "left_anti").unionByName(once)
    return out.select(*docs.columns)


def op8_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents"))
