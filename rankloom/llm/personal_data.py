"""Personal data: base patterns and bootstrapped contextual extraction.

``scan`` finds what the four base patterns match, per kind leftmost and without
overlap, and beside it *candidates*: addresses that no base pattern matches (with
other letters, or written "at" and "dot"), and every run of digit groups, within
longer runs too, that touches no base match; ``may`` names the kinds whose rules
(digits, Luhn sum, parts) a candidate fulfils. ``bootstrap`` learns which lexical
patterns announce which kind. Base matches are the seeds. The patterns of a seed or
candidate are the words around it, with back-off (two to the left, one, one on each
side, one to the right; words end ``CONTEXT`` characters away), and its own form:
the domain of an address, the digit grouping of a number, whole, without its first
group, and with runs of digits as one. Patterns and instances form a graph, which
Spark scores by turns: a pattern is as good as the share of its instances that are
known to be of the kind, an instance as good as its best pattern, seeds staying at
1. Candidates that a pattern of high confidence and support announces, and that may
be of its kind, become spans; their values are seeds of the next pass, wherever they
stand, so that they support further patterns. It stops when a pass makes no value a
seed that was none (then no pattern is added). Of added spans that overlap, the one
of the better pattern stays, then the longer, then the first.

Everything is DataFrame expressions. Texts are read once; the graph holds hashes
and counts of distinct (pattern, instance) pairs, so a pattern or an identifier
that is repeated a million times is one edge, summed where it is read.

Defined results: a null text is the empty text and has no spans; rows that agree
in id and text have equal spans; null ids stay null; an empty table gives an
empty result; positions count code points, ends are exclusive; other columns are
not read (``masked`` keeps all of them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_names, stored, text_of
from .fingerprints import let

KINDS = ("email", "ip", "card", "phone")
#: Java forms of the base patterns. Runs are possessive, and a match may start only
#: where a run starts or where the match before it ended: the same matches, found
#: in linear time and without recursion on long runs.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser shapes of things that the base patterns may miss.
ADDRESS = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D@]++"
SPELT = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]++(?:(?:\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?|\.)[A-Za-z0-9-]++)++"
DIGITS = r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().\x2F-]{0,3}+[0-9])++"
CONTEXT = 48
ROUNDS = 3
CONFIDENCE = 0.8
#: Distinct seeds that a pattern needs, base matches or values found before.
SUPPORT = 5
#: Added to the number of a pattern's instances: patterns seen rarely score low.
PRIOR = 1.0
BROADCAST_ROWS = 200_000

_SPANS = "array<struct<kind: string, start: int, end: int, value: string>>"


def _found(text: Column, pattern: str, kind: str) -> Column:
    """Every match, as (kind, start, end, value): starts from the lengths of what lies between."""

    def place(hits: Column) -> Column:
        def walk(parts: Column) -> Column:
            start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("starts"))

            def step(state: Column, i: Column) -> Column:
                first = state["at"] + F.length(F.get(parts, i))
                return F.struct((first + F.length(F.get(hits, i))).alias("at"), F.array_append(state["starts"], first).alias("starts"))

            starts = F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), start, step, lambda s: s["starts"])
            span = lambda h, at: F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.length(h)).alias("end"), h.alias("value"))
            return let(starts, lambda s: F.transform(hits, lambda h, i: span(h, F.get(s, i))))

        return F.when(F.size(hits) == 0, F.expr(f"cast(array() as {_SPANS})")).otherwise(let(F.split(text, pattern, -1), walk))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).when(n > 4, 2 * n - 9).otherwise(2 * n)

    ones = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(F.transform(ones, worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """What a match must fulfil besides the pattern."""
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}")
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The base matches of a text, by kind as listed, then by start."""
    none = F.expr(f"cast(array() as {_SPANS})")
    may = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.contains("+")}
    holding = lambda k: F.filter(_found(text, PATTERNS[k], k), lambda s: _holds(k, s["value"]))
    return F.concat(*(F.when(may[k], holding(k)).otherwise(none) for k in KINDS))


def _fits(kind: int, value: Column) -> Column:
    """Whether a run of digit groups fulfils the rules of a kind."""
    if KINDS[kind] == "ip":
        plain = F.regexp_replace(value, r"[\x20-]", ".")
        return plain.rlike(r"^[0-9]+(?:\.[0-9]+){3}$") & _holds("ip", plain)
    return _holds(KINDS[kind], value)


def _around(text: Column, start: Column, end: Column) -> Column:
    """The words beside a span: two to the left, one, one to the right, digits as 0; null where there are none."""
    first = F.greatest(start - CONTEXT, F.lit(0))
    left = F.lower(text.substr(first + 1, start - first))
    right = F.lower(text.substr(end + 1, F.lit(CONTEXT)))
    word = lambda s, k: F.nullif(F.regexp_replace(F.regexp_extract(s, k, 1), "[0-9]", "0"), F.lit(""))
    two, one = word(left, r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+[\x20\x09-\x0D]*)$"), word(left, r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)$")
    return F.struct(two.alias("two"), one.alias("one"), word(right, r"^([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)").alias("after"))


def _windows(run: Column, around: Column, cut_off: Column) -> Column:
    """Of a run of digit groups: every stretch of whole groups of 7 to 19 digits, with the kinds that it may be as bits.

    Only the first groups of a run have words to their left, and only the last to their right;
    these are no number's where the run is ``cut_off`` from what follows.
    """
    most = 2 * 19  # of two groups that follow each other one has a digit at least

    def stretches(groups: Column) -> Column:
        n = F.size(groups)

        def within(digits: Column) -> Column:
            total = lambda i, j: F.aggregate(F.slice(digits, i + 1, j - i + 1), F.lit(0), lambda x, y: x + y)
            ends = lambda i: F.filter(F.sequence(i, F.least(i + most, n - 1)), lambda j: total(i, j).between(7, 19) & ~(cut_off & (j == n - 1)))
            joined = lambda i, j: F.array_join(F.transform(F.slice(groups, i + 1, j - i + 1), lambda g: g["value"]), " ")
            beside = lambda i, j: F.struct(*(F.when(i == 0, around[k]).alias(k) for k in ("two", "one")), F.when(j == n - 1, around["after"]).alias("after"))
            cut = lambda i, j: F.struct((run["start"] + F.get(groups, i)["start"]).alias("start"), (run["start"] + F.get(groups, j)["end"]).alias("end"), joined(i, j).alias("value"), beside(i, j).alias("around"))
            return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(ends(i), lambda j: cut(i, j))))

        return let(F.transform(groups, lambda g: F.length(_digits(g["value"]))), within)

    bits = lambda v: sum((F.when(_fits(k, v), 1 << k).otherwise(0) for k in (1, 2, 3)), F.lit(0))
    made = let(_found(run["value"], r"[^\x20]++", "group"), lambda groups: F.when(F.size(groups) > 0, stretches(groups)))
    return F.transform(made, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["value"].alias("value"), bits(w["value"]).alias("may"), w["around"].alias("around")))


_NEAR = "array<struct<start: int, end: int, value: string, may: int, around: struct<two: string, one: string, after: string>>>"


def _candidates(text: Column, spans: Column) -> Column:
    """Looser finds that touch no base span, as (start, end, value, may, around)."""
    none = F.expr(f"cast(array() as {_NEAR})")
    free = lambda c: ~F.exists(spans, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
    whole = lambda found: F.transform(F.filter(found, free), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"), F.lit(1).alias("may"), _around(text, c["start"], c["end"]).alias("around")))
    addresses = F.when(text.contains("@"), whole(_found(text, ADDRESS, "email"))).otherwise(none)
    spelt = F.when(text.rlike(r"(?i)[\x20\[(]dot[\x20\])]"), whole(_found(text, SPELT, "email"))).otherwise(none)
    runs = F.filter(_found(text, DIGITS, "number"), lambda r: (F.length(_digits(r["value"])) >= 7) & free(r))
    cut_off = lambda r: text.substr(r["end"] + 1, F.lit(1)).rlike("[0-9A-Za-z@]")
    beside = lambda r: F.struct(_around(text, r["start"], r["end"]).alias("around"), cut_off(r).alias("cut_off"))
    numbers = F.when(text.rlike("[0-9].{0,3}[0-9]"), F.flatten(F.transform(runs, lambda r: let(beside(r), lambda x: _windows(r, x["around"], x["cut_off"]))))).otherwise(none)
    return F.concat(addresses, spelt, numbers)


def _patterns(value: Column, around: Column, seed: bool) -> Column:
    """Hashes of the lexical patterns of a span: the words beside it, with back-off, and its form."""
    beside = [F.when(F.concat(*(around[n] for n in names)).isNotNull(), F.xxhash64(F.lit(names[0]), *(around[n] for n in names))) for names in (("two",), ("one",), ("one", "after"), ("after",))]
    # an address by its domain, a number by its digit groups
    plain = F.regexp_replace(F.lower(value), r"\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?", "@")
    domain = F.regexp_replace(F.regexp_replace(F.substring_index(plain, "@", -1), r"\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?", "."), "[0-9]", "0")
    own = F.when(plain.contains("@"), domain).otherwise(F.regexp_replace(value, "[0-9]", "0"))

    def hashed(own: Column) -> Column:
        forms = [F.xxhash64(F.lit("form"), own), F.xxhash64(F.lit("short"), F.regexp_replace(own, "0+", "0"))]
        if seed:  # what such a seed looks like without its first group, as where a country code is left out
            forms.append(F.when(own.contains(" "), F.xxhash64(F.lit("form"), F.regexp_replace(own, r"^[^\x20]+\x20+", ""))))
        return F.array_distinct(F.filter(F.array(*beside, *forms), lambda p: p.isNotNull()))

    return let(own, hashed)


def scan(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, mark (a hash of the text), spans (base), near (patterns and value hashes of spans and candidates).

    ``seed`` is the place of a span's kind in ``KINDS``, or -1; ``may`` has the bits of a candidate's kinds.
    """
    rows = docs.select(docs[id_column].alias("id"), text_of(text_column).alias("text")).withColumn("spans", base_spans(F.col("text")))
    rows = rows.withColumn("loose", _candidates(F.col("text"), F.col("spans")))
    text = F.col("text")
    about = lambda s, seed, may, patterns: F.struct(seed.cast("int").alias("seed"), may.cast("int").alias("may"), s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(F.lower(s["value"])).alias("instance"), patterns.alias("patterns"))
    place = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]) - 1
    seeds = F.transform("spans", lambda s: let(_around(text, s["start"], s["end"]), lambda x: about(s, place(s), F.lit(0), _patterns(s["value"], x, True))))
    near = F.concat(seeds, F.transform("loose", lambda s: about(s, F.lit(-1), s["may"], _patterns(s["value"], s["around"], False))))
    plain = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select("id", F.xxhash64("text").alias("mark"), plain.alias("spans"), near.alias("near"))


def bootstrap(scanned: DataFrame, *, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """Patterns of high confidence: (pattern, kind, score), kind as its place in ``KINDS``."""
    seen = scanned.select(F.explode("near").alias("n")).select(F.explode("n.patterns").alias("pattern"), "n.instance", "n.seed", "n.may")
    edges = stored(seen.groupBy("pattern", "instance", "seed").agg(F.max("may").alias("may")))
    base = edges.filter("seed >= 0").select("pattern", "instance", F.col("seed").alias("kind"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(len(KINDS) - 1)), lambda k: F.getbit("may", k) == 1)
    loose = edges.filter("seed < 0 and may > 0").select("pattern", "instance", F.explode(bits).alias("kind"))
    totals = edges.groupBy(F.col("pattern").alias("of")).agg(F.count_distinct("instance").alias("instances"))
    known = None  # (instance, kind) of candidates that earlier passes made seeds
    while True:
        stand = base if known is None else base.unionAll(loose.join(known, ["instance", "kind"]).select("pattern", "instance", "kind"))
        # a pattern with fewer seeds is not accepted, and may get more in a later pass
        counted = stand.distinct().groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds")).filter(F.col("seeds") >= support)
        patterns = stored(counted.join(totals, F.col("pattern") == F.col("of")).select("pattern", "kind", "seeds", "instances"))
        graph = loose.join(patterns.select("pattern", "kind"), ["pattern", "kind"]).select("pattern", "instance", "kind")
        graph = stored(graph if known is None else graph.join(known, ["instance", "kind"], "left_anti").select("pattern", "instance", "kind"))
        good = stored(_scored(patterns, graph, rounds).filter(F.col("score") >= confidence))
        found = graph.join(good, ["pattern", "kind"]).groupBy("instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
        # a value keeps the kind that it was first a seed of
        fresh = stored(found if known is None else found.join(known.select("instance"), "instance", "left_anti"))
        if fresh.isEmpty():
            return good
        known = stored(fresh if known is None else known.unionAll(fresh))


def _scored(patterns: DataFrame, graph: DataFrame, rounds: int) -> DataFrame:
    """(pattern, kind, score) after so many rounds between patterns and the instances of ``graph`` that are no seeds."""
    scored = patterns.select("pattern", "kind", (F.col("seeds") / (F.col("instances") + PRIOR)).alias("score"))
    for _ in range(rounds):
        held = graph.join(scored, ["pattern", "kind"]).groupBy("instance", "kind").agg(F.max("score").alias("belief"))
        gained = graph.join(held, ["instance", "kind"]).groupBy("pattern", "kind").agg(F.sum("belief").alias("gain"))
        joined = patterns.join(gained, ["pattern", "kind"], "left")
        scored = stored(joined.select("pattern", "kind", ((F.col("seeds") + F.coalesce(F.col("gain"), F.lit(0.0))) / (F.col("instances") + PRIOR)).alias("score")))
    return scored


def discovered(scanned: DataFrame, patterns: DataFrame) -> DataFrame:
    """Per (id, mark) of texts with any: ``added``, the candidates that the patterns announce, without overlap."""
    loose = scanned.select("id", "mark", F.explode(F.filter("near", lambda n: (n["seed"] < 0) & (n["may"] > 0))).alias("n"))
    each = loose.select("id", "mark", "n.start", "n.end", "n.may", F.explode("n.patterns").alias("by"))
    hit = each.join(patterns, (F.col("by") == F.col("pattern")) & (F.getbit("may", F.col("kind")) == 1))
    one = hit.groupBy("id", "mark", "start", "end").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score"))
    ranked = one.groupBy("id", "mark").agg(F.collect_set(F.struct((-F.col("score")).alias("s"), (F.col("start") - F.col("end")).alias("n"), "start", "end", "kind")).alias("r"))
    clear = lambda held, x: ~F.exists(held, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    plain = lambda x: F.struct(F.get(F.array(*map(F.lit, KINDS)), x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    added = F.aggregate(F.sort_array("r"), F.expr("cast(array() as array<struct<kind: string, start: int, end: int>>)"), lambda held, x: F.when(clear(held, x), F.array_append(held, plain(x))).otherwise(held))
    return ranked.select("id", "mark", added.alias("added"))


def all_spans(scanned: DataFrame) -> DataFrame:
    """Per row: id, mark, spans (base), every (base and added), by kind as listed, then start."""
    added = discovered(scanned, bootstrap(scanned)).select(F.col("id").alias("of"), F.col("mark").alias("as"), "added")
    joined = scanned.select("id", "mark", "spans").join(added, F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("as")), "left")
    place = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)])
    keyed = F.transform(F.concat("spans", F.coalesce("added", F.expr("cast(array() as array<struct<kind: string, start: int, end: int>>)"))), lambda s: F.struct(F.element_at(place, s["kind"]).alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return joined.select("id", "mark", "spans", F.transform(F.sort_array(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("every"))


def joined_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: id, the number of base spans of each kind, base and all spans as text."""
    every = all_spans(checkpointed(scan(docs, id_column=id_column, text_column=text_column)))
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = {f"n_{k}": of_kind(k) for k in KINDS}
    return every.select(F.col("id").alias(id_column), *(c.alias(n) for n, c in counts.items()), joined_text(F.col("spans")).alias("base"), joined_text(F.col("every")).alias("spans"))


def masked(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; spans that overlap become one."""
    scanned = checkpointed(scan(docs, id_column=id_column, text_column=text_column))
    of_id, of_mark, spans = free_names(docs, "of_id", "of_mark", "spans")
    every = all_spans(scanned).filter(F.size("every") > 0).groupBy(F.col("id").alias(of_id), F.col("mark").alias(of_mark)).agg(F.first("every").alias(spans))
    every = checkpointed(every)
    few = every.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    text = text_of(text_column)
    joined = docs.join(F.broadcast(every) if few else every, docs[id_column].eqNullSafe(F.col(of_id)) & (F.xxhash64(text) == F.col(of_mark)), "left")

    def step(state: Column, s: Column) -> Column:
        fresh = F.struct(F.concat(state["out"], text.substr(state["at"] + 1, s["start"] - state["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] < state["at"], F.struct(state["out"].alias("out"), F.greatest(state["at"], s["end"]).alias("at"))).otherwise(fresh)

    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    out = F.aggregate(ordered, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.length(text))))
    return joined.withColumn(text_column, F.when(F.col(spans).isNull(), docs[text_column]).otherwise(out)).drop(of_id, of_mark, spans)
