"""Personal data: fixed kinds by pattern, further ones by bootstrapped contexts.

Base spans of the kinds email, ip, card and phone are leftmost non-overlapping matches of
fixed patterns that pass a kind's test. They are the seeds of a bootstrap over the whole
corpus: the words beside a seed induce lexical patterns; patterns and the instances
found in them form a graph; in turns, an instance's score is drawn from its patterns
and a pattern's from its instances; patterns that end with a high score and enough
distinct seeds mark the unseen identifiers in their slots.

Everything is DataFrame and SQL functions; no Python runs on the executors. Patterns use
possessive loops and anchors where that changes no match, so that long texts need neither
deep stacks nor quadratic time. Arrays are scanned in chunks (see scan), so that the time
grows as the number of a text's spans. A context's words are whole, however long they are.

Edge cases: null and empty texts have no spans; repeated doc_ids are rows of their own
as long as their texts differ, and each gets its own spans; an empty table gives no
rows; other columns are not read. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stash

KINDS = ("email", "ip", "card", "phone")
_SPAN = "struct<kind:string,start:int,end:int,value:string>"

# The patterns of the kinds, with possessive loops.
_NAME = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_NAME})){_NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind's pattern to be tried.
_NEEDS = {"email": "[A-Za-z0-9._%+-]@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the checksum."""
    figures = F.reverse(F.split(digits, ""))
    worth = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
        return F.forall(F.split(s, r"\."), small)
    n = F.length(_digits(s))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(13, 19), luhn(_digits(s))).otherwise(False)


#: Entries of an array that are scanned together: what a chunk gives is copied once for each of its entries.
CHUNK = 32


def _let(value: Column, use) -> Column:
    """use(value), the value computed once: expressions within a lambda are computed for every entry."""
    return F.get(F.transform(F.array(value), use), 0)


def scan(items: Column, zero: Column, step, emit, kind: str) -> Column:
    """Array of the entries emit(state, item) that are not null, in order; step(state, item) is the next state.

    Appending to an array copies it. So the states before each chunk are found first, then what each chunk
    gives, which keeps the time near to linear in the length.
    """
    none = F.array().cast(f"array<{kind}>")

    def within(chunk: Column, state: Column) -> Column:
        def one(a, x):
            found = emit(a["state"], x)
            return F.struct(step(a["state"], x).alias("state"), F.concat(a["out"], F.filter(F.array(found), lambda f: f.isNotNull())).alias("out"))

        return F.aggregate(chunk, F.struct(state.alias("state"), none.alias("out")), one, lambda a: a["out"])

    def chunked(items: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda i: F.slice(items, i * CHUNK + 1, F.lit(CHUNK)))

    def found(chunks: Column) -> Column:
        start = F.struct(zero.alias("state"), F.slice(F.array(zero), 1, 0).alias("before"))
        states = F.aggregate(chunks, start, lambda a, c: F.struct(F.aggregate(c, a["state"], step).alias("state"), F.concat(a["before"], F.array(a["state"])).alias("before")), lambda a: a["before"])
        return F.flatten(F.zip_with(chunks, states, within))

    return _let(items, lambda x: F.when(F.size(x) > CHUNK, _let(chunked(x), found)).otherwise(within(x, zero)))


def _matches(text: Column, pattern: str, kind: str, build, use) -> Column:
    """An array of build(start, match) for a pattern's matches that pass use(match); kind is the result's struct type.

    The texts between matches and the matches alternate, so offsets are running lengths.
    """
    between = F.transform(F.split(text, pattern, -1), lambda s: F.length(s))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    items = F.zip_with(between, found, lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
    return scan(
        items,
        F.lit(0),
        lambda at, x: at + x["gap"] + F.coalesce(F.length(x["value"]), F.lit(0)),
        lambda at, x: F.when(x["value"].isNotNull() & use(x["value"]), build(at + x["gap"], x["value"])),
        kind,
    )


def _located(kind: str, text: Column) -> Column:
    """array<struct<kind, start, end, value>> of a kind's valid matches."""
    span = lambda start, value: F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))
    return _matches(text, PATTERNS[kind], _SPAN, span, lambda value: _valid(kind, value))


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds base: array<struct<kind, start, end, value>>, by kind as listed, then start."""
    empty = F.array().cast(f"array<{_SPAN}>")
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = [F.when(text.rlike(_NEEDS[k]), _located(k, text)).otherwise(empty) for k in KINDS]
    return docs.withColumn("base", F.concat(*parts))


# ---------------------------------------------------------------- bootstrap

#: A token that could be an identifier: no white space, with a digit or an @ within.
_TOKEN = r"(?<!\S)(?=[^\s@0-9]*+[@0-9])\S++"
_MARKS = r"^[\"'(\[<{]+|[\"')\]>},;:!?.]+$"


def _contexts(text: Column, start: Column, end: Column) -> Column:
    """A span's lexical patterns: the two words before it; the words on either side."""
    # Texts on either side: longer ones where the words do not end within shorter ones.
    pick = lambda sides, whole: F.coalesce(*(F.when(s.rlike(whole), s) for s in sides[:-1]), sides[-1])
    before = [F.substring(text, F.greatest(start - n + 1, F.lit(1)), F.least(start, F.lit(n))) for n in (80, 4096)]
    before = pick([*before, F.substring(text, F.lit(1), start)], r"\s\S+\s+\S+\s*$")
    after = [F.substring(text, end + 1, F.lit(n)) for n in (40, 4096)]
    after = pick([*after, F.substring(text, end + 1, F.length(text))], r"^\S*\s+\S+\s")

    def patterns(before: Column, after: Column) -> Column:
        two = F.lower(F.regexp_extract(before, r"(\S+\s+\S+)\s*$", 1))
        one = F.lower(F.regexp_extract(before, r"(\S+)\s*$", 1))
        next_ = F.lower(F.regexp_extract(after, r"^\S*\s*(\S+)", 1))
        found = F.array(F.when(two != "", F.regexp_replace(two, r"\s+", " ")), F.when((one != "") & (next_ != ""), F.concat(one, F.lit(" * "), next_)))
        return F.filter(found, lambda p: p.isNotNull())

    return _let(F.struct(before.alias("before"), after.alias("after")), lambda x: patterns(x["before"], x["after"]))


_FREE = "struct<start:int,end:int,value:string,rank:int>"


def _free(candidates: Column, base: Column) -> Column:
    """Candidates that overlap no base span: two sweeps over both in order, one from either end."""
    entry = lambda s, rank: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(rank).alias("rank"))
    both = F.concat(F.transform(base, lambda s: entry(s, 0)), F.transform(candidates, lambda s: entry(s, 1)))
    forward = scan(F.array_sort(both), F.lit(0), lambda at, x: F.when(x["rank"] == 0, F.greatest(at, x["end"])).otherwise(at), lambda at, x: F.when((x["rank"] == 0) | (x["start"] >= at), x), _FREE)
    far = F.lit(2**31 - 1)
    backward = scan(F.reverse(forward), far, lambda at, x: F.when(x["rank"] == 0, F.least(at, x["start"])).otherwise(at), lambda at, x: F.when((x["rank"] == 1) & (x["end"] <= at), x), _FREE)
    return F.when(F.size(base) == 0, F.transform(candidates, lambda s: entry(s, 1))).otherwise(backward)


def _candidates(text: Column) -> Column:
    """array<struct<start, end, value>> of tokens with an @ or at least four digits."""
    return _matches(text, _TOKEN, "struct<start:int,end:int,value:string>", _trimmed, lambda v: v.contains("@") | (F.length(_digits(v)) >= 4))


def _trimmed(start: Column, token: Column) -> Column:
    lead = F.length(token) - F.length(F.regexp_replace(token, r"^[\"'(\[<{]+", ""))
    value = F.regexp_replace(token, _MARKS, "")
    return F.struct((start + lead).cast("int").alias("start"), (start + lead + F.length(value)).cast("int").alias("end"), value.alias("value"))


def learn_patterns(graph: DataFrame, rounds: int = 3, least: float = 0.8, seeds: int = 5) -> DataFrame:
    """kind, pattern of the patterns to trust, from graph(pattern, instance, kind; kind null: unseen).

    Scores start at 1 for a kind's seeds and 0 for others. A pattern's score is the mean
    score of its distinct instances, an instance's the complement of the product of its
    patterns' complements; seeds keep 1.
    """
    edges = stash(graph.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))
    support = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= seeds)
    size = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    known = stash(support.join(size, "pattern"))
    links = stash(edges.withColumnRenamed("kind", "own").join(known.select("pattern", "kind"), "pattern"))
    score = known.select("pattern", "kind", (F.col("seeds") / F.col("size")).alias("score"))
    for _ in range(rounds):
        instance = links.join(score, ["pattern", "kind"]).groupBy("instance", "kind").agg(
            F.max(F.coalesce((F.col("own") == F.col("kind")).cast("double"), F.lit(0.0))).alias("seed"),
            (1 - F.exp(F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999)))))).alias("belief"),
        )
        instance = instance.select("instance", "kind", F.greatest("seed", "belief").alias("belief"))
        score = links.join(instance, ["instance", "kind"]).groupBy("pattern", "kind").agg(F.avg("belief").alias("score"))
        score = stash(score)
    return score.join(known, ["pattern", "kind"]).where((F.col("score") >= least) & (F.col("seeds") / F.col("size") >= 0.5)).select("pattern", "kind")


def discover(docs: DataFrame, rounds: int = 3, least: float = 0.8, seeds: int = 5) -> DataFrame:
    """_id, _key (hash of the text), more: the spans the bootstrap adds; none overlaps a base span."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = base_spans(docs.where(F.col("text").rlike("[@0-9]")))
    text = F.col("text")
    def placed(spans: Column, kind) -> DataFrame:
        """A row for each span and pattern; the contexts are found first, so that no text is copied to each span."""
        told = F.transform(spans, lambda s: F.struct(kind(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), _contexts(text, s["start"], s["end"]).alias("patterns")))
        rows = found.select("doc_id", F.xxhash64("text").alias("key"), F.explode(told).alias("s"))
        return rows.select("doc_id", "key", "s.kind", "s.start", "s.end", "s.value", F.explode("s.patterns").alias("pattern"))

    seeds_at = placed(F.col("base"), lambda s: s["kind"])
    others = placed(_free(_candidates(text), F.col("base")), lambda s: F.lit(None).cast("string"))
    seen = stash(seeds_at.unionByName(others))
    trusted = learn_patterns(seen.select("pattern", F.lower("value").alias("instance"), "kind"), rounds, least, seeds)
    added = seen.where("kind is null").drop("kind").join(trusted, "pattern").groupBy("doc_id", "key", "start", "end").agg(F.min("kind").alias("kind"), F.first("value").alias("value"))
    more = added.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end", "value"))).alias("more"))
    return stash(more)


def find(docs: DataFrame, **options) -> DataFrame:
    """docs with base and more. Additions are written first: if they are few they are broadcast, as Spark sees their size."""
    more = discover(docs, **options)
    same = docs.doc_id.cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs.text) == F.col("_key"))
    none = F.array().cast(f"array<{_SPAN}>")
    return base_spans(docs).join(more, same, "left").drop("_id", "_key").withColumn("more", F.coalesce("more", none))


def _listed(spans: Column) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    found = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), **options)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.concat("base", "more")).alias("spans"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """docs with each span of its text replaced by its kind in brackets; other columns as they are."""
    found = find(docs.select("doc_id", "text", F.struct(*(docs[c] for c in docs.columns)).alias("row")), **options)
    spans = F.array_sort(F.transform(F.concat("base", "more"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s["kind"].alias("kind"))))
    between = lambda a, b: F.substring(F.col("text"), a + 1, F.greatest(b - a, F.lit(0)))
    step = lambda a, s: F.struct(
        F.greatest(a["at"], -s["last"]).alias("at"),
        F.concat(a["out"], between(a["at"], s["start"]), F.when(s["start"] >= a["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))).alias("out"),
    )
    clean = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], between(a["at"], F.length("text"))))
    clean = F.when(F.size(F.concat("base", "more")) > 0, clean).otherwise(F.col("text"))
    return found.select(*(clean.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
