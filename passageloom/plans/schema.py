"""What an answer may look like: one tree, from which everything else is derived.

A tree of fields, lists and texts with their bounds gives the table schema (ddl), the
JSON schema that a model is told (json_schema), the predicate of a struct (fits), the
strict reading of a model's JSON as VARIANT (problems, value), and the same check
where a worker has the answer in hand (problems_of). A bound may grow with the words
of the passage.

Reading is strict: a number is no text, a missing or null field is an error, and so is
what stands outside its bounds or its closed set; keys beyond the schema are ignored.
Booleans may be written as they often are ("true", 1, "no"). Each error names its
place, as in items[2].label.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import length_bound, let

#: How a boolean may be written.
YES, NO = ("true", "t", "yes", "y", "on", "1"), ("false", "f", "no", "n", "off", "0")


def said(path: Column, *what: Column | str) -> Column:
    return F.array(F.concat(path, F.lit(": "), *[F.lit(w) if isinstance(w, str) else w for w in what]))


def nothing() -> Column:
    return F.array().cast("array<string>")


@dataclass(frozen=True)
class Text:
    """A string: of most characters; or of words of the passage times grows[0], and
    grows[1] at least, as soon as that product is more than `beyond`; or of choices."""

    most: int | None = None
    grows: tuple[int, int] | None = None
    beyond: int = -1
    choices: tuple[str, ...] = ()

    def ddl(self) -> str:
        return "string"

    def bound(self, n_words: int | None) -> int | None:
        if self.grows is None or n_words is None:
            return self.most
        times, least = self.grows
        return max(least, n_words * times) if n_words * times > self.beyond else None

    def bound_column(self, n_words: Column) -> Column | None:
        if self.grows is None:
            return None if self.most is None else F.lit(self.most)
        grown = length_bound(n_words, *self.grows)
        return F.when(n_words * self.grows[0] > self.beyond, grown) if self.beyond >= 0 else grown

    def json_schema(self, n_words: int | None = None) -> dict:
        most = self.bound(n_words)
        return {"type": "string"} | ({"enum": list(self.choices)} if self.choices else {}) | ({"maxLength": most} if most is not None else {})

    def fits(self, x: Column, n_words: Column) -> Column:
        ok, most = x.isNotNull(), self.bound_column(n_words)
        if most is not None:
            ok = ok & F.coalesce(F.length(x) <= most, F.lit(True))
        return ok & x.isin(*self.choices) if self.choices else ok

    def problems(self, v: Column, path: Column, n_words: Column) -> Column:
        s = F.try_variant_get(v, "$", "string")
        found = F.when(v.isNull(), said(path, "missing")).when(F.schema_of_variant(v) != "STRING", said(path, "not a string"))
        if (most := self.bound_column(n_words)) is not None:
            found = found.when(F.length(s) > most, said(path, F.length(s).cast("string"), " characters, ", most.cast("string"), " at most"))
        if self.choices:
            found = found.when(~s.isin(*self.choices), said(path, "not one of " + ", ".join(self.choices)))
        return found.otherwise(nothing())

    def value(self, v: Column) -> Column:
        return F.try_variant_get(v, "$", "string")

    def problems_of(self, x: Any, path: str, n_words: int) -> list[str]:
        if not isinstance(x, str):
            return [f"{path}: not a string"]
        most = self.bound(n_words)
        if most is not None and len(x) > most:
            return [f"{path}: {len(x)} characters, {most} at most"]
        return [f"{path}: not one of {', '.join(self.choices)}"] if self.choices and x not in self.choices else []


@dataclass(frozen=True)
class Flag:
    def ddl(self) -> str:
        return "boolean"

    def json_schema(self, n_words: int | None = None) -> dict:
        return {"type": "boolean"}

    def fits(self, x: Column, n_words: Column) -> Column:
        return x.isNotNull()

    def value(self, v: Column) -> Column:
        written = F.lower(F.try_variant_get(v, "$", "string"))
        simple = F.schema_of_variant(v).isin("BOOLEAN", "STRING", "BIGINT")
        return F.when(simple & written.isin(*YES), F.lit(True)).when(simple & written.isin(*NO), F.lit(False))

    def problems(self, v: Column, path: Column, n_words: Column) -> Column:
        return F.when(v.isNull(), said(path, "missing")).when(self.value(v).isNull(), said(path, "not a boolean")).otherwise(nothing())

    def problems_of(self, x: Any, path: str, n_words: int) -> list[str]:
        return [] if isinstance(x, (bool, str, int)) and str(x).lower() in YES + NO else [f"{path}: not a boolean"]


@dataclass(frozen=True)
class Other:
    """A value of another type, such as a number in a task of one's own."""

    kind: str

    def ddl(self) -> str:
        return self.kind

    @property
    def whole(self) -> bool:
        return self.kind in ("tinyint", "smallint", "int", "bigint")

    @property
    def number(self) -> bool:
        return self.kind in ("float", "double") or self.kind.startswith("decimal")

    def json_schema(self, n_words: int | None = None) -> dict:
        return {"type": "integer" if self.whole else "number" if self.number else "string"}

    def fits(self, x: Column, n_words: Column) -> Column:
        return x.isNotNull()

    def value(self, v: Column) -> Column:
        return F.try_variant_get(v, "$", self.kind)

    def problems(self, v: Column, path: Column, n_words: Column) -> Column:
        return F.when(v.isNull(), said(path, "missing")).when(self.value(v).isNull(), said(path, f"no {self.kind}")).otherwise(nothing())

    def problems_of(self, x: Any, path: str, n_words: int) -> list[str]:
        try:
            made = None if x is None or isinstance(x, (dict, list)) else int(x) if self.whole else float(x) if self.number else x
        except (ValueError, OverflowError):
            made = None
        return [f"{path}: no {self.kind}"] if made is None else []


@dataclass(frozen=True)
class Items:
    """A list of `least` to `most` of one kind."""

    of: Node
    least: int = 0
    most: int | None = None

    def ddl(self) -> str:
        return f"array<{self.of.ddl()}>"

    def json_schema(self, n_words: int | None = None) -> dict:
        bounds = ({"minItems": self.least} if self.least else {}) | ({"maxItems": self.most} if self.most is not None else {})
        return {"type": "array", "items": self.of.json_schema(n_words)} | bounds

    def many(self, n: Column) -> Column:
        return n.between(self.least, self.most) if self.most is not None else n >= self.least

    def fits(self, x: Column, n_words: Column) -> Column:
        return x.isNotNull() & self.many(F.size(x)) & F.forall(x, lambda y: self.of.fits(y, n_words))

    def items(self, v: Column) -> Column:
        return F.try_variant_get(v, "$", "array<variant>")

    def value(self, v: Column) -> Column:
        return F.transform(self.items(v), self.of.value)

    def problems(self, v: Column, path: Column, n_words: Column) -> Column:
        def inside(xs: Column) -> Column:
            n = F.size(xs)
            range_ = f"{self.least} to {self.most}" if self.most is not None else f"{self.least} at least"
            each = F.flatten(F.transform(xs, lambda x, i: self.of.problems(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), n_words)))
            return F.when(self.many(n), each).otherwise(said(path, n.cast("string"), f" items, {range_}"))

        listed = F.schema_of_variant(v).startswith("ARRAY")
        return F.when(v.isNull(), said(path, "missing")).when(~listed, said(path, "not a list")).otherwise(let(self.items(v), inside))

    def problems_of(self, x: Any, path: str, n_words: int) -> list[str]:
        if not isinstance(x, list):
            return [f"{path}: not a list"]
        if len(x) < self.least or self.most is not None and len(x) > self.most:
            return [f"{path}: {len(x)} items, {self.least} to {self.most}"]
        return [p for k, y in enumerate(x) for p in self.of.problems_of(y, f"{path}[{k}]", n_words)]


@dataclass(frozen=True)
class Fields:
    """An object; its keys in order."""

    of: tuple[tuple[str, Node], ...]

    def ddl(self) -> str:
        return f"struct<{', '.join(f'{n}: {x.ddl()}' for n, x in self.of)}>"

    @property
    def table(self) -> str:
        """The fields as a table schema."""
        return ", ".join(f"{n} {x.ddl()}" for n, x in self.of)

    def json_schema(self, n_words: int | None = None) -> dict:
        return {"type": "object", "properties": {n: x.json_schema(n_words) for n, x in self.of}, "required": [n for n, _ in self.of], "additionalProperties": False}

    def fits(self, x: Column, n_words: Column) -> Column:
        ok = x.isNotNull()
        for name, node in self.of:
            ok = ok & F.coalesce(node.fits(x[name], n_words), F.lit(False))
        return ok

    def value(self, v: Column) -> Column:
        return F.struct(*[x.value(F.try_variant_get(v, f"$.{n}", "variant")).alias(n) for n, x in self.of])

    def problems(self, v: Column, path: Column, n_words: Column) -> Column:
        def of(name: str, node: Node) -> Column:
            at = F.concat(path, F.when(path == "", "").otherwise("."), F.lit(name))
            return let(F.try_variant_get(v, f"$.{name}", "variant"), lambda x: node.problems(x, at, n_words))

        found = F.flatten(F.array(*[of(n, x) for n, x in self.of]))
        return F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), said(path, "not an object")).otherwise(found)

    def problems_of(self, x: Any, path: str = "", n_words: int = 0) -> list[str]:
        if not isinstance(x, dict):
            return [f"{path}: not an object"]
        dot = "." if path else ""
        return [p for n, node in self.of for p in (node.problems_of(x[n], f"{path}{dot}{n}", n_words) if n in x else [f"{path}{dot}{n}: missing"])]


Node = Text | Flag | Other | Items | Fields


def fields(**of: Node) -> Fields:
    return Fields(tuple(of.items()))


def many(least: int, most: int | None, of: Node | None = None, **each: Node) -> Items:
    """A list of one kind, or of objects of these fields."""
    return Items(of or fields(**each), least, most)


def grows(node: Node) -> bool:
    """Whether a bound of it grows with the words of the passage."""
    if isinstance(node, Fields):
        return any(grows(x) for _, x in node.of)
    return grows(node.of) if isinstance(node, Items) else isinstance(node, Text) and node.grows is not None


def from_ddl(schema: str) -> Fields:
    """The tree of a table schema, without bounds."""

    def of(kind: T.DataType) -> Node:
        if isinstance(kind, T.ArrayType):
            return Items(of(kind.elementType))
        if isinstance(kind, T.StructType):
            return Fields(tuple((f.name, of(f.dataType)) for f in kind.fields))
        known: dict[type, Callable[[], Node]] = {T.StringType: Text, T.BooleanType: Flag}
        return known[type(kind)]() if type(kind) in known else Other(kind.simpleString())

    return of(T.StructType.fromDDL(schema))
