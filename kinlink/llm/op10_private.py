r"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust their score.

Everything is DataFrame functions. Each kind has a pattern written so that Java's matcher needs time linear in the
text and no recursion: quantifiers are possessive where nothing can be given back, and a match starts only where a
run of its characters starts or where the match before ended (\G). Matches and the gaps between them give the
offsets: the text is their alternation, so offsets are running sums of lengths in code points.

Kinds email, ip, card and phone (the base) are always kept once confirmed. Kinds iban (mod-97) and ssn are added
where their score, lifted by context words and lowered by words that speak against it, is at least ADDED_AT.

Null and empty texts: no spans. Very long texts are read whole, in time linear in the text and its matches. Null
doc_ids, repeated rows and ids: one result each. Empty tables: empty results. Extra columns are ignored. Overlapping
spans of different kinds are all reported; masking goes kind by kind in the order of MASKED.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.common import table

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    # whole runs of digits with single separators, of 16 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9_])",
    "ssn": r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])",
}
BASE = ("email", "ip", "card", "phone")
#: What a text must hold for a kind's pattern to be tried at all.
NEEDS = {"email": ("@", "."), "ip": (".",), "phone": ("+",), "ssn": ("-",), "card": (), "iban": ()}
#: Score of a confirmed span before its context is read.
START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4}
#: Words within NEAR code points before or after a span, in lower case, that speak for its kind.
CONTEXT = {
    "email": ("mail", "contact", "courriel", "correo"),
    "ip": ("address", "server", "host", "client"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
AGAINST = {"ip": ("version", "release"), "card": ("isbn", "serial", "order"), "phone": ("isbn",), "ssn": ("part no", "serial", "order")}
NEAR, LIFT, DROP, ADDED_AT = 40, 0.2, 0.3, 0.5
#: Order of masking; a later kind sees the text that earlier ones left.
MASKED = ("email", "iban", "card", "phone", "ip", "ssn")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    """Whether the digits of c pass Luhn's check."""
    d = F.reverse(digits(c))

    def add(total: Column, i: Column) -> Column:
        x = d.substr(i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def mod97(c: Column) -> Column:
    """Whether an IBAN, blanks aside, leaves 1 modulo 97 with its first four characters moved to the end."""
    s = F.regexp_replace(c, r"\x20", "")
    chars = F.split(F.concat(s.substr(F.lit(5), F.length(s)), s.substr(F.lit(1), F.lit(4))), "(?!^)(?!$)")

    def add(rest: Column, x: Column) -> Column:
        n = F.ascii(x) - F.when(x >= "A", 55).otherwise(48)
        return (rest * F.when(n >= 10, 100).otherwise(10) + n) % 97

    return (F.length(s) >= 15) & (F.aggregate(chars, F.lit(0), add) == 1)


def confirmed(kind: str, c: Column) -> Column:
    if kind == "ip":
        bare = F.transform(F.split(c, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(bare, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return luhn(c)
    if kind == "phone":
        return F.length(digits(c)).between(8, 15)
    if kind == "iban":
        return mod97(c)
    if kind == "ssn":
        return ~c.rlike("^(?:000|666|9)") & ~c.rlike("-00-|-0000$")
    return F.lit(True)


def holds(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def score(kind: str, near: Column) -> Column:
    out = F.lit(START[kind]) + F.when(holds(near, CONTEXT[kind]), LIFT).otherwise(0.0)
    if kind in AGAINST:
        out = out - F.when(holds(near, AGAINST[kind]), DROP).otherwise(0.0)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def proposed(df: DataFrame, text: str) -> DataFrame:
    """Adds for each kind the arrays _m_<kind> (matches) and _g_<kind> (the gaps around them, one more)."""
    none, t = F.array().cast("array<string>"), F.col(text)
    cols = {}
    for kind, pattern in PATTERNS.items():
        m, g = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern, -1)
        if NEEDS[kind]:
            may = F.lit(True)
            for sign in NEEDS[kind]:
                may = may & t.contains(sign)
            m = F.when(may, m).otherwise(none)
        cols[f"_m_{kind}"] = m
        cols[f"_g_{kind}"] = (kind, g)
    df = df.withColumns({k: v for k, v in cols.items() if k.startswith("_m_")})
    return df.withColumns({k: F.when(F.size(f"_m_{v[0]}") > 0, v[1]).otherwise(none) for k, v in cols.items() if k.startswith("_g_")})


SPAN = "struct<start:int,end:int,score:double>"
#: Matches whose offsets are summed together.
CHUNK = 256


def offset(df: DataFrame) -> DataFrame:
    """Adds for each kind _s_<kind>, the starts of its matches: running sums over gaps and matches.

    Sums run within chunks of CHUNK matches and over the chunks' totals, so that no long array is copied for each
    match. Every step's column is read twice by the next one, as the optimiser would write one that is read once into
    the lambdas and so compute it for each element.
    """
    none = F.array().cast("array<int>")
    chunks = lambda kind: F.sequence(F.lit(0), F.floor((F.size(f"_m_{kind}") - 1) / CHUNK).cast("int"))
    own = lambda kind, c: F.slice(f"_l_{kind}", c * CHUNK + 1, CHUNK)
    some = lambda kind, x: F.when(F.size(f"_m_{kind}") > 0, x)

    def lengths(kind: str) -> Column:
        m, g = F.col(f"_m_{kind}"), F.col(f"_g_{kind}")
        return F.transform(m, lambda x, i: F.struct(F.length(F.get(g, i)).alias("gap"), F.length(x).alias("match")))

    def totals(kind: str) -> Column:
        return F.transform(chunks(kind), lambda c: F.aggregate(own(kind, c), F.lit(0), lambda a, x: a + x["gap"] + x["match"]))

    def bases(kind: str) -> Column:
        before = F.transform(chunks(kind), lambda c: F.aggregate(F.slice(f"_t_{kind}", 1, c), F.lit(0), lambda a, x: a + x))
        return F.when(F.size(f"_t_{kind}") > 0, before)

    def starts(kind: str) -> Column:
        def chunk(c: Column) -> Column:
            zero = F.struct(F.get(f"_b_{kind}", c).alias("at"), none.alias("out"))
            add = lambda a, x: F.struct((a["at"] + x["gap"] + x["match"]).alias("at"), F.concat(a["out"], F.array(a["at"] + x["gap"])).alias("out"))
            return F.aggregate(own(kind, c), zero, add)["out"]

        return F.when(F.size(f"_b_{kind}") > 0, F.flatten(F.transform(chunks(kind), chunk)))

    for tag, step in (("l", lengths), ("t", totals), ("b", bases), ("s", starts)):
        df = df.withColumns({f"_{tag}_{kind}": some(kind, step(kind)) for kind in PATTERNS})
    return df


def spans_of(kind: str) -> Column:
    """Confirmed spans of a kind, in order."""
    m, g, s = F.col(f"_m_{kind}"), F.col(f"_g_{kind}"), F.col(f"_s_{kind}")

    def one(x: Column, i: Column) -> Column:
        near = F.lower(F.concat(F.right(F.get(g, i), F.lit(NEAR)), F.lit(" "), F.left(F.get(g, i + 1), F.lit(NEAR))))
        value = score(kind, near)
        keep = confirmed(kind, x) if kind in BASE else confirmed(kind, x) & (value >= ADDED_AT)
        return F.when(keep, F.struct(F.get(s, i).alias("start"), (F.get(s, i) + F.length(x)).alias("end"), value.alias("score")).cast(SPAN))

    return F.when(F.size(m) > 0, F.filter(F.transform(m, one), lambda x: x.isNotNull())).otherwise(F.array().cast(f"array<{SPAN}>"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id and one array of spans (start, end, score; code points, end exclusive) for each kind."""
    df = offset(proposed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")), "_t"))
    return df.select("doc_id", *[spans_of(k).alias(k) for k in PATTERNS])


def mask(text: Column, kind: str) -> Column:
    """text with the confirmed spans of a kind replaced by its name in angle brackets, joined from matches and gaps."""
    m, g = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), F.split(text, PATTERNS[kind], -1)

    def part(x: Column, i: Column) -> Column:
        near = F.lower(F.concat(F.right(F.get(g, i), F.lit(NEAR)), F.lit(" "), F.left(F.get(g, i + 1), F.lit(NEAR))))
        keep = confirmed(kind, x) if kind in BASE else confirmed(kind, x) & (score(kind, near) >= ADDED_AT)
        return F.concat(F.get(g, i), F.when(keep, F.lit(f"<{kind.upper()}>")).otherwise(x))

    return F.when(text.rlike(PATTERNS[kind]), F.concat(F.array_join(F.transform(m, part), ""), F.element_at(g, -1))).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """docs with confirmed spans of all kinds masked in text; null texts stay null, other columns as they are."""
    for kind in MASKED:
        may = F.lit(True)
        for sign in NEEDS[kind]:
            may = may & F.col("text").contains(sign)
        docs = docs.withColumn("text", F.when(may, mask(F.col("text"), kind)).otherwise(F.col("text")))
    return docs


def op10_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))

    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))

    def listed(kinds) -> Column:
        return F.array_join(F.concat(*map(named, kinds)), ",")

    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(BASE), 256).alias("base_sha256"),
        listed(PATTERNS).alias("spans"),
        F.array_join(F.concat(*[F.transform(k, lambda s: F.format_number(s["score"], 2)) for k in PATTERNS]), ",").alias("scores"),
    )


# DuckDB: plain patterns (its matcher is linear and knows no look-around), the same checks and context.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
_D = "regexp_replace(s.m, '[^0-9]', '', 'g')"
_I = "replace(s.m, ' ', '')"
_LUHN = f"list_sum(list_transform(range(1, length({_D}) + 1), lambda i: case when i % 2 = 1 then substr(reverse({_D}), i, 1)::int when substr(reverse({_D}), i, 1)::int > 4 then 2 * substr(reverse({_D}), i, 1)::int - 9 else 2 * substr(reverse({_D}), i, 1)::int end)) % 10 = 0"
_MOD97 = f"list_reduce(list_prepend(0, list_transform(string_split(substr({_I}, 5) || substr({_I}, 1, 4), ''), lambda x: case when x >= 'A' then ascii(x) - 55 else ascii(x) - 48 end)), lambda a, n: (a * (case when n >= 10 then 100 else 10 end) + n) % 97) = 1"
_CHECK = {
    "email": "true",
    "ip": "len(list_filter(string_split(s.m, '.'), lambda p: length(ltrim(p, '0')) > 3 or (length(ltrim(p, '0')) = 3 and ltrim(p, '0') > '255'))) = 0",
    "card": f"length({_D}) between 16 and 19 and {_LUHN}",
    "phone": f"length({_D}) between 8 and 15",
    "iban": f"length({_I}) >= 15 and {_MOD97}",
    "ssn": "not regexp_matches(s.m, '^(000|666|9)') and not regexp_matches(s.m, '-00-|-0000$')",
}


def _spans_sql(kind: str) -> str:
    m, g = f"regexp_extract_all(t, '{_PLAIN[kind]}')", f"string_split_regex(t, '{_PLAIN[kind]}')"
    near = f"lower(right(({g})[i], {NEAR}) || ' ' || left(({g})[i + 1], {NEAR}))"
    at = f"coalesce(list_sum(list_transform(({g})[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(({m})[1:i - 1], lambda x: length(x))), 0)"
    has = lambda words: " or ".join(f"contains(s.near, '{w}')" for w in words)
    value = f"{START[kind]} + case when {has(CONTEXT[kind])} then {LIFT} else 0 end" + (f" - case when {has(AGAINST[kind])} then {DROP} else 0 end" if kind in AGAINST else "")
    value = f"least(greatest({value}, 0), 1)"
    each = f"list_transform(range(1, len({m})::bigint + 1), lambda i: struct_pack(m := ({m})[i], a := ({at})::bigint, near := {near}))"
    fine = _CHECK[kind] if kind in BASE else f"{_CHECK[kind]} and {value} >= {ADDED_AT}"
    return f"list_transform(list_filter({each}, lambda s: {fine}), lambda s: struct_pack(span := '{kind}:' || s.a || ':' || (s.a + length(s.m)), score := printf('%.2f', ({value})::double)))"


_LISTS = ", ".join(f"{_spans_sql(k)} as {k}" for k in PATTERNS)
_NAMED = lambda kinds: "array_to_string(list_transform(" + "list_concat(" * (len(kinds) - 1) + kinds[0] + "".join(f", {k})" for k in kinds[1:]) + ", lambda s: s.span), ',')"
_EVERY = tuple(PATTERNS)
OP10_SQL = f"""
with d as (select doc_id, coalesce(text, '') as t from documents), f as (select doc_id, {_LISTS} from d)
select doc_id, {", ".join(f"len({k})::bigint as n_{k}" for k in BASE)},
       sha256({_NAMED(BASE)}) as base_sha256, {_NAMED(_EVERY)} as spans, {_NAMED(_EVERY).replace("s.span", "s.score")} as scores
from f"""
