"""Personal data by base patterns and by bootstrapped contexts, in DataFrame functions alone.

Base spans of four kinds come from fixed patterns. They are the seeds: every
token with a digit or an @ (neighbouring ones together) is a slot with a
context, the two words before it, and a slot that overlaps a base span is an
instance of its kind. Spark then scores the graph of contexts and instances in
rounds: a context's confidence is the scores of the distinct instances of a
kind over all distinct values in that context; contexts with `support`
instances and the `confidence` are patterns of the kind, a value that patterns
extract scores 1 - prod(1 - confidence), and values that score enough and have
the kind's loose shape are instances of the next round. Slots of such values
that overlap no base span become added spans. Secrets (keys, hashes, passwords)
are a fifth kind, whose seeds are slots of their shape; their spans are added ones.

Starts and ends are code points, the end exclusive. Null and empty texts have
no spans. Rows map one to one, repeated ones too; columns of the input other
than the two named are not read. Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlake.llm.common import written

KINDS = ("email", "ip", "card", "phone")
NAMES = (*KINDS, "secret")

# The patterns of the task, with possessive loops and anchored starts: they match
# the same spans, take linear time and no stack on long runs. \G is the end of
# the previous match, where a run may go on. A card is a whole run of digits.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a match of each kind holds, so that most texts need no search.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: [^\s0-9@]*+[0-9@]\S*+)*+"
#: What a value must look like to be taken as an instance of a kind.
SHAPES = {
    "email": r"^[^\s@]+@[^\s@]+$",
    "ip": r"^[0-9]{1,4}(?:\.[0-9]{1,4}){3}$",
    "card": r"^[0-9](?:[\x20-]?[0-9]){12,18}$",
    "phone": r"^\(?[0-9](?:[\x20().-]{0,3}[0-9]){6,14}$",
    "secret": r"^(?:[a-z_][a-z0-9_.-]*[=:])?[a-z0-9+/_=-]{8,}$",
}
#: A slot of a secret's shape: a run of 16 or more of a key's characters with letters and digits, by itself or after a name and = or :.
SECRET = r"^(?:[A-Za-z_][A-Za-z0-9_.-]*[=:])?(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}={0,2}$"
#: The two words before a slot, whatever their length.
BEFORE = r"(\S++\s++\S++)\s*+$"
STRETCH = 1024
SPAN = "array<struct<start:bigint,end:bigint,value:string,before:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    at = F.sequence(F.lit(1), F.length(digits))

    def part(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(at, F.lit(0), lambda total, i: total + part(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.split(value, r"\."), lambda part: ~part.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans(text: Column, pattern: str, hint: str | None = None) -> Column:
    """Matches (start, end, value) of a pattern, each with the two words before it.

    Ends add up from match to match, in runs of about the root of their number,
    as each step copies what its run has so far: n ** 1.5 steps for n matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.struct(F.length(p).alias("n"), F.regexp_extract(p, BEFORE, 1).alias("before")))
    none = F.array().cast(SPAN)

    def step(so_far: Column, part: Column) -> Column:
        start = so_far["at"] + part["piece"]["n"]
        end = start + F.length(part["value"])
        one = F.struct(start.alias("start"), end.alias("end"), part["value"].alias("value"), part["piece"]["before"].alias("before"))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(part["value"].isNull(), so_far["out"]).otherwise(F.concat(so_far["out"], F.array(one))).alias("out"))

    def walk(parts: Column) -> Column:
        run = F.ceil(F.sqrt(F.size(parts))).cast("int")

        def one_run(so_far: Column, i: Column) -> Column:
            inner = F.aggregate(F.slice(parts, i * run + 1, run), F.struct(so_far["at"].alias("at"), none.alias("out")), step)
            return _bound(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(so_far["out"], r["out"]).alias("out")))

        return F.aggregate(F.sequence(F.lit(0), F.ceil(F.size(parts) / run).cast("int") - 1), F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out")), one_run, lambda all_of: all_of["out"])

    some = F.size(found) > 0 if hint is None else F.contains(text, F.lit(hint)) & (F.size(found) > 0)
    return F.when(some, _bound(F.arrays_zip(pieces.alias("piece"), found.alias("value")), walk)).otherwise(none)


def extract(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, id, base, slots): the spans of the fixed patterns and all slots of each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    matched = rows.select("id", *(spans(F.col("text"), PATTERNS[k], HINTS[k]).alias(k) for k in KINDS), spans(F.col("text"), TOKEN).alias("slot"))

    def of_kind(place: int, kind: str) -> Column:
        valid = F.filter(kind, lambda s: _valid(kind, s["value"]))
        return F.transform(valid, lambda s: F.struct(F.lit(place).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    def slot(s: Column) -> Column:
        lead = F.length(F.regexp_extract(s["value"], r"^[^\p{L}0-9+(]*+", 0))
        value = F.regexp_replace(s["value"], r"^[^\p{L}0-9+(]++|[^\p{L}0-9]++$", "")
        return F.struct((s["start"] + lead).alias("start"), (s["start"] + lead + F.length(value)).alias("end"), s["start"].alias("from"), s["end"].alias("to"), value.alias("value"), F.lower(s["before"]).alias("context"))

    base = F.concat(*(of_kind(i, k) for i, k in enumerate(KINDS)))
    return matched.select(F.monotonically_increasing_id().alias("uid"), "id", base.alias("base"), F.transform("slot", slot).alias("slots"))


def labelled(rows: DataFrame) -> DataFrame:
    """(uid, start, end, value, context, kind): all slots, with the kind of a base span that overlaps them, or that of a secret's shape.

    Slots and spans meet by stretches of STRETCH code points, so a text of many takes no more than its length.
    """
    stretches = lambda start, end: F.explode(F.sequence(F.floor(start / STRETCH), F.floor((end - 1) / STRETCH)))
    slots = rows.select("uid", F.explode("slots").alias("s")).select("uid", "s.*")
    spanned = rows.select("uid", F.explode("base").alias("b")).select("uid", "b.*").select("uid", "kind", F.col("start").alias("low"), F.col("end").alias("high"), stretches(F.col("start"), F.col("end")).alias("part"))
    placed = slots.select("uid", "from", "to", stretches(F.col("from"), F.col("to")).alias("part"))
    kinds = placed.join(spanned, ["uid", "part"]).filter("low < to and high > from").groupBy("uid", "from").agg(F.min("kind").alias("kind"))
    secret = F.when(F.col("value").rlike(SECRET), F.lit(len(KINDS)))
    return slots.join(kinds, ["uid", "from"], "left").select("uid", "start", "end", F.lower("value").alias("value"), "context", F.coalesce("kind", secret).alias("kind"), F.col("kind").isNull().alias("free"))


def discovered(slots: DataFrame, rounds: int, support: int, confidence: float) -> DataFrame:
    """(kind, value) of values that confident contexts extract; slots (value, context, kind)."""
    edges = written(slots.filter("context <> '' and value <> ''").groupBy("context", "value").agg(F.min("kind").alias("kind")), "edges")
    totals = edges.groupBy("context").agg(F.count("*").alias("total"))
    seeds = edges.filter("kind is not null").select("kind", "value").distinct().withColumn("score", F.lit(1.0))
    known = seeds
    for _ in range(rounds):
        hits = edges.select("context", "value").join(known, "value").groupBy("context", "kind").agg(F.count("*").alias("n"), F.sum("score").alias("mass"))
        patterns = hits.filter(F.col("n") >= support).join(totals, "context").withColumn("trust", F.col("mass") / F.col("total")).filter(F.col("trust") >= confidence)
        found = edges.join(patterns.select("context", F.col("kind").alias("as_kind"), "trust"), "context").filter("kind is null")
        shaped = [(F.col("as_kind") == i) & F.col("value").rlike(SHAPES[k]) for i, k in enumerate(NAMES)]
        scored = found.filter(reduce(Column.__or__, shaped)).groupBy(F.col("as_kind").alias("kind"), "value").agg((1 - F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.999)))))).alias("score"))
        known = written(seeds.union(scored.filter(F.col("score") >= confidence)), "known")
    return known.join(seeds, ["kind", "value"], "left_anti").select("kind", "value")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, support: int = 5, confidence: float = 0.8) -> DataFrame:
    """(id, base, added): spans (kind, start, end) per row, kind being a place in KINDS."""
    rows = written(extract(docs, id_col, text_col), "spans")
    slots = written(labelled(rows), "slots")
    values = discovered(slots, rounds, support, confidence)
    found = slots.filter("kind is null").drop("kind").join(values, "value").select("uid", "kind", "start", "end")
    secrets = slots.filter(F.col("free") & (F.col("kind") == len(KINDS))).select("uid", "kind", "start", "end")
    new = found.union(secrets).groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("added"))
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    return rows.join(new, "uid", "left").select("id", "base", F.coalesce("added", none).alias("added"))


def listed(found: Column) -> Column:
    """Spans as text: kind:start:end, by kind as in NAMES, then by start, joined by commas."""
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
