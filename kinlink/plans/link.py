"""The linkage pipeline from entity tables to match lists."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.functions import kernels, text
from kinlink.operators import blocking, cells, decide, keys, model, pair_features, prescreen
from kinlink.plans.store import fresh, written


@dataclass(frozen=True)
class LinkConfig:
    """Caps and thresholds. Keys that more than cap targets of a country have are pruned; gram_cap is the cap of 4-gram keys.

    A query keeps the max_candidates targets that share most keys with it, and of those the per_entity best of the channels.
    """

    cap: int = 1500
    gram_cap: int = 250
    max_candidates: int = 250
    per_entity: int = 60
    theta: float = 0.88
    least: float = 0.70
    shared_scripts: bool = True
    by: tuple[str, ...] = ("country",)
    caps: dict[str, int] = field(default_factory=dict)


def normalised(entities: DataFrame) -> DataFrame:
    """entities with norm_name, rom_name, norm_addr, number, acronym, has_legal; the same for queries and targets."""
    forms = entities.withColumn("_forms", kernels.second_forms("business_name", "business_address", "country"))
    return forms.withColumns({
        **{c: F.col("_forms")[c] for c in ("norm_name", "rom_name", "norm_addr")},
        "number": text.primary_number("business_address"),
        "acronym": text.acronym("business_name"),
        "has_legal": text.has_legal("business_name"),
    }).drop("_forms")


def normalised_first(entities: DataFrame) -> DataFrame:
    """entities with the column-wise first-generation norm_name, has_legal and norm_addr."""
    return entities.withColumns({
        "norm_name": text.name_columnwise("business_name"),
        "has_legal": text.has_legal("business_name", dotted=False),
        "norm_addr": text.address_columnwise("business_address"),
    })


#: What the second generation's scores and features read of an entity.
FORMS = ("norm_name", "rom_name", "norm_addr", "number", "acronym", "has_legal")


def entity_keys(entities: DataFrame, query: bool, config: LinkConfig) -> DataFrame:
    c = F.col
    own = keys.v2_keys(c("business_name"), c("business_address"), c("norm_name"), c("norm_addr"), c("rom_name"), query, config.shared_scripts)
    return blocking.long_keys(entities, own, *config.by)


def target_index(targets: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """Keys of normalised targets without the frequent ones, numbered. All keys are written first, as they are counted and then kept."""
    own = written(entity_keys(targets, False, config), "keys")
    return blocking.numbered(blocking.pruned(own, config.cap, {"g4:": config.gram_cap} | config.caps, config.by), config.by)


def candidates(s1: DataFrame, s23: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """s1_id, cand_id, n_keys of normalised entities; a query meets targets of its country only. All of them, before any cap."""
    return blocking.block_numbered(entity_keys(s1, True, config), target_index(s23, config), config.by)


@dataclass(frozen=True)
class Cells:
    """Normalised targets as operators.cells reads them.

    rows has by, entity_id, keys and FORMS; frequent the keys that are pruned, by group; odd the groups that are not dealt
    to cells, as they are too large or hold an id that repeats.
    """

    rows: DataFrame
    frequent: DataFrame
    odd: DataFrame


def spread(entities: DataFrame) -> DataFrame:
    """Raw entities dealt to twice as many tasks as run at once: Spark splits a file by its bytes, which say little of the work that forms and keys take."""
    return entities.repartition(2 * entities.sparkSession.sparkContext.defaultParallelism, "entity_id")


def keyed(entities: DataFrame, query: bool, config: LinkConfig, *columns: str) -> DataFrame:
    """by, entity_id, keys, FORMS and columns of normalised entities; without by, all are one group."""
    c = F.col
    own = keys.v2_keys(c("business_name"), c("business_address"), c("norm_name"), c("norm_addr"), c("rom_name"), query, config.shared_scripts)
    return entities.select(*(config.by or [F.lit(0).alias("_all")]), "entity_id", own.alias("keys"), *FORMS, *others(config, columns))


def groups(config: LinkConfig) -> tuple[str, ...]:
    return config.by or ("_all",)


def others(config: LinkConfig, columns) -> list[str]:
    return [c for c in columns if c not in config.by]


def target_cells(targets: DataFrame, config: LinkConfig = LinkConfig(), path: str | None = None, columns: tuple[str, ...] = ()) -> Cells:
    """Cells of normalised targets, written in the shared folder."""
    path, by = path or fresh(targets.sparkSession, "index"), groups(config)
    rows = written(keyed(targets, False, config, *columns), "index", f"{path}/rows")
    often = cells.frequent(rows, by, config.cap, {"g4:": config.gram_cap} | config.caps)
    odd = cells.large(rows, by).union(cells.repeated(rows, by)).distinct()
    return Cells(rows, written(often, "index", f"{path}/frequent"), written(odd, "index", f"{path}/odd"))


def link(s1: DataFrame, s23: DataFrame, config: LinkConfig = LinkConfig(), fitted=None) -> tuple[DataFrame, DataFrame]:
    """Kept candidates (s1_id, cand_id, comp, rank) and matches (s1_id, cand_id, score) of raw entity tables.

    fitted is a model of plans.training or operators.model; without one the rule scores. What several branches read is
    written once in the shared folder (plans.store): keys and forms of targets, kept candidates with the rule's scores.
    """
    index = target_cells(normalised(s23), config)
    return link_prepared(s1, index.rows, index, config, fitted)


def dealt(one: DataFrame, index: Cells, ids: DataFrame, config: LinkConfig, run, shape: str, *columns: str) -> DataFrame:
    """What run makes of the blocks of keyed queries and targets, which it gets with keys, texts and columns."""
    by, texts = groups(config), (*cells.TEXTS, *columns)
    often = index.frequent.select(*by, F.lit(None).cast("string").alias("entity_id"), F.array("key").alias("keys"), *[F.lit(None).cast(index.rows.schema[c].dataType).alias(c) for c in texts])
    own, theirs = (x.select(*by, "entity_id", "keys", *texts) for x in (one, index.rows))
    return cells.met(own, theirs.unionByName(often), by, ids, run, shape)


def parted(one: DataFrame, index: Cells, odd: DataFrame, by: tuple[str, ...]) -> tuple[tuple[DataFrame, Cells], tuple[DataFrame, DataFrame]]:
    """Queries and cells without the odd groups, and queries and targets of those; an id that repeats may have a row without a group."""
    (a, b), nowhere = (one, index.rows), " or ".join(f"{c} is null" for c in by)
    own, theirs = (x.join(odd, list(by), "left_anti") for x in (a, b))
    return (own, Cells(theirs, index.frequent, odd)), tuple(x.join(odd, list(by), "left_semi").union(x.filter(nowhere)) for x in (a, b))


def ids_of(entities: DataFrame, config: LinkConfig) -> DataFrame:
    return entities.select(*(config.by or [F.lit(0).alias("_all")]), "entity_id")


def link_prepared(s1: DataFrame, targets: DataFrame, index: Cells, config: LinkConfig = LinkConfig(), fitted=None) -> tuple[DataFrame, DataFrame]:
    """The same for targets that are normalised and keyed already."""
    by, one, ids = groups(config), keyed(normalised(s1), True, config), ids_of(s1, config)
    odd = written(index.odd.union(cells.repeated(ids, by)).distinct(), "odd")
    rest = not odd.isEmpty()
    if rest or fitted is not None:
        one = written(one, "queries")
    (own, near), others = parted(one, index, odd, by) if rest else ((one, index), ())

    def run(queries, rows):
        return cells.linked(queries, rows, config.max_candidates, config.per_entity, config.theta, config.least)

    met = written(dealt(own, near, ids, config, run, cells.SHAPE), "kept")
    kept, matches = met.select("s1_id", "cand_id", "comp", "rank"), met.filter("matched").select("s1_id", "cand_id", "score")
    if rest:
        more = shuffled(*others, config)
        kept, matches = kept.union(more), matches.union(matched(more, *others, config))
    return kept, matches if fitted is None else matched(kept, one, targets, config, fitted)


def everywhere(one: DataFrame, two: DataFrame, config: LinkConfig, run, shape: str, of_pairs, *columns: str) -> DataFrame:
    """What run makes of the blocks of normalised entities with columns, and of_pairs of the texts of all candidates of the odd groups."""
    by, index, ids = groups(config), target_cells(two, config, None, columns), ids_of(one, config)
    one, more = keyed(one, True, config, *columns), (cells.LEGAL, *others(config, columns))
    odd = written(index.odd.union(cells.repeated(ids, by)).distinct(), "odd")
    if odd.isEmpty():
        return dealt(one, index, ids, config, run, shape, *more)
    (own, near), rest = parted(written(one, "queries"), index, odd, by)
    pairs = prescreen.attributes(shared(*rest, config).select("s1_id", "cand_id"), *rest, *FORMS, *columns)
    return dealt(own, near, ids, config, run, shape, *more).union(of_pairs(pairs))


def vectors(one: DataFrame, two: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """pair_features.second of all candidates of normalised entities, made where the queries meet their group's targets."""
    shape = "s1_id string, cand_id string, " + ", ".join(f"{c} float" for c in pair_features.SECOND)
    return everywhere(one, two, config, cells.vectors, shape, pair_features.second)


def first_vectors(one: DataFrame, two: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """The same for pair_features.first."""
    shape = "s1_id string, cand_id string, " + ", ".join(f"{c} float" for c in pair_features.FIRST)
    return everywhere(one, two, config, cells.first_vectors, shape, pair_features.first, "country")


LEADING = "s1_id string, cand_id string, score double, rank int"


def first_best(one: DataFrame, two: DataFrame, k: int = 30, config: LinkConfig = LinkConfig()) -> DataFrame:
    """LEADING: prescreen.first_top of all candidates of normalised entities, ranked where the queries meet their group's targets."""
    ratio = kernels.KERNELS["ratio"]

    def run(queries, rows):
        return cells.leading(queries, rows, k, 1.2, [("norm_name", 100, ratio)])

    return everywhere(one, two, config, run, LEADING, lambda pairs: prescreen.first_top(pairs, k).select("s1_id", "cand_id", "score", "rank"))


def sixth_best(one: DataFrame, two: DataFrame, k: int = 28, config: LinkConfig = LinkConfig()) -> DataFrame:
    """The same by prescreen.sixth_score."""
    set_ratio = kernels.KERNELS["set_ratio"]

    def run(queries, rows):
        queries, rows = (x.append_column("folded", [[kernels.fold(n or "").lower() for n in x["business_name"].to_pylist()]]) for x in (queries, rows))
        return cells.leading(queries, rows, k, 1.25, [("norm_name", 100, cells.better), ("folded", None, set_ratio)])

    of_pairs = lambda pairs: blocking.top(prescreen.sixth_score(pairs), k, F.desc("score")).select("s1_id", "cand_id", "score", "rank")
    return everywhere(one, two, config, run, LEADING, of_pairs, "business_name")


def shared(one: DataFrame, two: DataFrame, config: LinkConfig) -> DataFrame:
    """candidates of keyed entities."""
    by = groups(config)
    queries, index = (blocking.long_keys(x, F.col("keys"), *by) for x in (one, two))
    return blocking.block_numbered(queries, blocking.numbered(blocking.pruned(index, config.cap, {"g4:": config.gram_cap} | config.caps, by), by), by)


def shuffled(one: DataFrame, two: DataFrame, config: LinkConfig) -> DataFrame:
    """Kept candidates of keyed entities whose pairs are shuffled: of groups of any size, and of ids that repeat."""
    pairs = blocking.capped(shared(one, two, config), config.max_candidates)
    scored = prescreen.channel_scores(prescreen.attributes(pairs.select("s1_id", "cand_id"), one, two, *FORMS))
    return written(prescreen.channels(written(scored.select(*prescreen.CHANNELS), "channels"), config.per_entity), "kept")


def matched(pairs: DataFrame, one: DataFrame, two: DataFrame, config: LinkConfig = LinkConfig(), fitted=None) -> DataFrame:
    """s1_id, cand_id, score of the matches among pairs of normalised entities; pairs with an unknown id go."""
    vectors = pair_features.second(prescreen.attributes(pairs.select("s1_id", "cand_id"), one, two, *FORMS))
    rated = model.score(fitted, vectors) if fitted is not None else model.rule_score(vectors)
    return decide.with_fallback(rated, config.theta, config.least)


def rescored(lists: DataFrame, s1: DataFrame, s23: DataFrame, config: LinkConfig = LinkConfig(), fitted=None) -> DataFrame:
    """s1_id and ids for every query of a candidate file's pairs (s1_id, cand_id): scored and decided anew, without blocking.

    Only entities that occur in the pairs are normalised. Matches are among a query's own candidates by construction.
    """
    pairs = lists.select("s1_id", "cand_id").distinct()
    one, two = (x.join(pairs.select(F.col(c).alias("entity_id")).distinct(), "entity_id", "left_semi") for x, c in ((s1, "s1_id"), (s23, "cand_id")))
    return decide.lists(s1, matched(pairs, normalised(one), normalised(two), config, fitted))


def rescored_candidates(s1: DataFrame, s23: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """rescored of all candidates of the raw entities by the rule, rated where the queries meet their group's targets: no file of pairs is made."""

    def run(queries, rows):
        return cells.rated(queries, rows, config.theta, config.least)

    def of_pairs(pairs):
        return decide.lists(pairs.select(F.col("s1_id").alias("entity_id")).distinct(), decide.with_fallback(model.rule_score(pair_features.second(pairs)), config.theta, config.least))

    each = everywhere(normalised(s1), normalised(s23), config, run, "s1_id string, ids string", of_pairs)
    return s1.select(F.col("entity_id").alias("s1_id")).join(each.hint("shuffle_merge"), "s1_id", "left").select("s1_id", F.coalesce("ids", F.lit("")).alias("ids"))
