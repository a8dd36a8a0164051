"""Search predicates as expressions over items, compiled to Columns.

Fields are paths of the payload's JSON: $... as given, meta.x under $.meta,
others under `root`. In the cold dialect texts are compared as they are and a
missing field makes a predicate null, so NOT leaves it out; in the hot dialect
texts are compared by lower-case tokens and a missing field is false.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBERS = "^(BIGINT|DOUBLE|DECIMAL.*)$"


@dataclass(frozen=True)
class Dialect:
    hot: bool = False
    root: str = "$"

    def path(self, field: str) -> str:
        if field.startswith("$"):
            return field
        return f"$.{field}" if field.startswith("meta.") else f"{self.root}.{field}"

    def text(self, field: str) -> Column:
        return F.get_json_object("payload", self.path(field))

    def number(self, field: str) -> Column:
        """The field as a double if JSON has it as a number, else null."""
        v = F.try_parse_json("payload")
        kind = F.schema_of_variant(F.try_variant_get(v, self.path(field), "variant"))
        return F.when(kind.rlike(NUMBERS), F.try_variant_get(v, self.path(field), "double"))

    def boolean(self, field: str) -> Column:
        v = F.try_parse_json("payload")
        return F.when(F.schema_of_variant(F.try_variant_get(v, self.path(field), "variant")) == "BOOLEAN", F.try_variant_get(v, self.path(field), "boolean"))

    def tags(self, field: str) -> Column:
        """The field's tags: a list's members, or a text alone."""
        v = F.try_parse_json("payload")
        return F.coalesce(F.try_variant_get(v, self.path(field), "array<string>"), F.array(F.try_variant_get(v, self.path(field), "string")))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


@dataclass(frozen=True)
class Query:
    """One predicate or combination; combine with & | ~."""

    kind: str
    field: str = ""
    value: object = None
    parts: tuple[Query, ...] = ()

    def __and__(self, other: Query) -> Query:
        return Query("and", parts=(self, other))

    def __or__(self, other: Query) -> Query:
        return Query("or", parts=(self, other))

    def __invert__(self) -> Query:
        return Query("not", parts=(self,))

    def column(self, dialect: Dialect = Dialect()) -> Column:
        if self.kind == "all":
            return F.lit(True)
        if self.kind == "and":
            return reduce(lambda a, b: a & b, (p.column(dialect) for p in self.parts), F.lit(True))
        if self.kind == "or":
            return reduce(lambda a, b: a | b, (p.column(dialect) for p in self.parts)) if self.parts else F.lit(True)
        if self.kind == "not":
            inner = self.parts[0].column(dialect)
            return ~F.coalesce(inner, F.lit(False)) if dialect.hot else ~inner
        return getattr(self, f"_{self.kind}")(dialect)

    def _text(self, d: Dialect) -> Column:
        if d.hot:
            return F.size(F.array_except(tokens(F.lit(self.value)), tokens(d.text(self.field)))) == 0
        return d.text(self.field) == self.value

    def _number(self, d: Dialect) -> Column:
        return d.number(self.field) == float(self.value)

    def _boolean(self, d: Dialect) -> Column:
        return d.boolean(self.field) == self.value

    def _contains(self, d: Dialect) -> Column:
        return F.contains(d.text(self.field), F.lit(self.value))

    def _range(self, d: Dialect) -> Column:
        low, high = self.value
        if low is None and high is None:
            return d.number(self.field).isNotNull() if d.hot else F.lit(True)
        x = d.number(self.field)
        over = x >= float(low) if low is not None else F.lit(True)
        return over & (x <= float(high)) if high is not None else over

    def _tags(self, d: Dialect) -> Column:
        return F.arrays_overlap(d.tags(self.field), F.array(*map(F.lit, self.value))) if self.value else F.lit(False)

    def _prefix(self, d: Dialect) -> Column:
        return F.startswith(d.text(self.field), F.lit(self.value))

    def _fuzzy(self, d: Dialect) -> Column:
        if d.hot:
            return F.exists(tokens(d.text(self.field)), lambda t: F.levenshtein(t, F.lit(str(self.value).lower()), 1) >= 0)
        return F.contains(d.text(self.field), F.lit(self.value))


ALL = Query("all")


def text_eq(field: str, value: str) -> Query:
    return Query("text", field, value)


def numeric_eq(field: str, value: float) -> Query:
    return Query("number", field, value)


def bool_eq(field: str, value: bool) -> Query:
    return Query("boolean", field, value)


def contains(field: str, value: str) -> Query:
    return Query("contains", field, value)


def between(field: str, low: float | None = None, high: float | None = None) -> Query:
    return Query("range", field, (low, high))


def tags(field: str, *values: str) -> Query:
    return Query("tags", field, values)


def prefix(field: str, value: str) -> Query:
    return Query("prefix", field, value)


def fuzzy(field: str, value: str) -> Query:
    return Query("fuzzy", field, value)


def search(items: DataFrame, query: Query, dialect: Dialect = Dialect(), key_prefix: str | None = None, limit: int | None = None) -> DataFrame:
    """Items that match, in the order of ids if limited."""
    found = items.filter(F.startswith("object_id", F.lit(key_prefix))) if key_prefix else items
    found = found.filter(query.column(dialect))
    return found if limit is None else found.orderBy("object_id").limit(limit)


def view_prefix(index_prefix: str) -> str:
    return index_prefix.replace("crdt:", "view:", 1)


def distance(vector: Column, query: list[float], metric: str) -> Column:
    """Smaller is nearer: l2, ip (1 - inner product) or cosine (1 - cosine)."""
    v, q = vector.cast("array<double>"), F.array(*(F.lit(float(x)) for x in query))

    def total(column: Column) -> Column:
        return F.aggregate(column, F.lit(0.0), lambda a, b: a + b)

    dot = total(F.zip_with(v, q, lambda a, b: a * b))
    if metric == "l2":
        return F.sqrt(total(F.zip_with(v, q, lambda a, b: (a - b) * (a - b))))
    if metric == "ip":
        return 1 - dot
    return 1 - dot / (F.sqrt(total(F.transform(v, lambda a: a * a))) * F.sqrt(F.lit(sum(x * x for x in map(float, query)))))


def nearest(items: DataFrame, query: list[float], k: int, metric: str = "l2", where: Query = ALL, vector: str = "vector") -> DataFrame:
    """The k nearest items among those that match, by the whole distance, ties by id."""
    scored = items.filter(where.column()).select("object_id", distance(F.col(vector), query, metric).alias("vector_score"))
    return scored.orderBy("vector_score", "object_id").limit(k)
