"""Text expressions that the tasks are made of; all of them native columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is stripped from a word before it may be masked, how long
#: a maskable word is at least, how many are masked, words of a passage at least.
WORD_EDGES = ".,;:!?()\"'"
MASKABLE, BLANKS, LEAST_WORDS = 6, 3, 10


def cat(*parts: Column | str) -> Column:
    """Concatenation of columns and of plain strings."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


#: Unicode white space.
BLANK = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK))


def words(text: Column) -> Column:
    """Runs of anything but (Unicode) white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Cut at white space after a full stop, exclamation or question mark."""
    return F.filter(F.split(strip(text), r"(?U)(?<=[.!?])\s+"), lambda s: s != "")


def collapse(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"(?U)\s+", " ")


def count_words(text: Column) -> Column:
    return F.size(words(text))


def length_bound(n_words: Column, eighths: int, minimum: int) -> Column:
    """Characters that a generated text may have: words times a multiplier times
    eight characters, the multiplier given as that product; minimum at least."""
    return F.greatest(F.lit(minimum), (n_words * eighths).cast("int"))


def quote_in(quote: Column, passage: Column) -> Column:
    """Whether the passage holds the quote, whatever its case and spacing; an
    empty quote is in every passage."""
    return F.contains(flat(passage), flat(quote))


def flat(text: Column) -> Column:
    """What quotes are looked for in: lower case, spacing collapsed."""
    return F.lower(collapse(text))


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """text with the first old, in any case, replaced; null where there is none,
    where old or new is empty, or where they are equal."""
    at = F.position(F.lower(old), F.lower(text))
    changed = F.overlay(text, new, at, F.length(old))
    return F.when((old != "") & (new != "") & (old != new) & (at > 0), changed)


def numbered(items: Column) -> Column:
    """A line "1. item" for each item."""
    return F.array_join(F.transform(items, lambda x, i: cat((i + 1).cast("string"), ". ", x)), "\n")


def dashed(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: cat("- ", x)), "\n")


def json_string(text: Column) -> Column:
    """A JSON string literal, non-ASCII letters as they are."""
    inside = F.to_json(F.array(text))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def json_list(items: Column) -> Column:
    """A JSON array of strings with ", " between them."""
    return cat("[", F.array_join(F.transform(items, json_string), ", "), "]")


def json_object(**fields: Column) -> Column:
    """A JSON object of strings, ", " and ": " between its parts."""
    parts = [cat(f'"{name}": ', json_string(value)) for name, value in fields.items()]
    return cat("{", F.concat_ws(", ", *parts), "}")


def json_objects(items: Column, *names: str) -> Column:
    one = lambda x: json_object(**{n: x[n] for n in names})
    return cat("[", F.array_join(F.transform(items, one), ", "), "]")


def json_indented(**fields: Column) -> Column:
    """A JSON object of strings as it is printed with an indent of two and sorted
    keys; a null is null."""
    lines = [cat(f'  "{name}": ', F.when(value.isNull(), "null").otherwise(json_string(value))) for name, value in sorted(fields.items())]
    return cat("{\n", F.concat_ws(",\n", *lines), "\n}")


def barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once, however often they are used: the
    optimiser copies a projected expression into each of its uses, but never
    through a generator."""
    if not columns:
        return df
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("once_")
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*kept, made).select(*kept, *[F.col(f"once_.{n}").alias(n) for n in columns])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is computed once, within an expression."""
    return F.transform(F.array(value), use)[0]


def list_literal(items: Column) -> Column:
    """The items as a Python list of strings is printed."""

    def literal(x: Column) -> Column:
        for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
            x = F.replace(x, F.lit(raw), F.lit(shown))
        double = F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"'))
        return F.when(double, cat('"', x, '"')).otherwise(cat("'", F.replace(x, F.lit("'"), F.lit("\\'")), "'"))

    return cat("[", F.array_join(F.transform(items, literal), ", "), "]")


def maskable(text: Column) -> Column:
    """Distinct alphabetic words of six letters or more, without the punctuation
    at their edges, the longest first; ties by lower case, then as they are."""
    edge = "[" + "".join("\\" + c for c in WORD_EDGES) + "]*"
    fit = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?U)(?<!\S){edge}(\p{{L}}{{{MASKABLE},}}){edge}(?!\S)"), F.lit(1)))
    ranked = F.array_sort(F.transform(fit, lambda w: F.struct((-F.length(w)).alias("n"), F.lower(w).alias("l"), w.alias("w"))))
    return F.transform(ranked, lambda x: x["w"])


def mask_words(text: Column, chosen: Column) -> Column:
    """The first whole occurrence of each chosen word as [BLANK n]. Words and what
    stands between them are cut out once; a whole occurrence is a word of its own, so
    those of two chosen words never meet."""
    word = r"(?U)\w+"

    def splice(x: Column) -> Column:
        at = F.transform(chosen, lambda w: F.array_position(x["words"], w))
        shown = lambda k: let(F.array_position(at, (k + 1).cast("long")), lambda n: F.when(n > 0, cat("[BLANK ", n.cast("string"), "]")).otherwise(F.coalesce(F.get(x["words"], k), F.lit(""))))
        return F.array_join(F.transform(x["between"], lambda s, k: cat(s, shown(k))), "")

    return let(F.struct(F.regexp_extract_all(text, F.lit(word), F.lit(0)).alias("words"), F.split(text, word).alias("between")), splice)


def part_of(items: Column, divisor: int) -> Column:
    """Items in one part of divisor: one at least, none of none."""
    return F.when(F.size(items) > 0, F.greatest(F.lit(1), F.floor(F.size(items) / divisor).cast("int"))).otherwise(0)


def joined(items: Column) -> Column:
    return F.array_join(items, " ")


def bucket(key: Column, n: int | Column) -> Column:
    """A number below n that depends on the key only."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(n) if isinstance(n, int) else n)


def template(pattern: str, fields: dict[str, Column]) -> Column:
    """A format string with {field} places, filled from columns."""
    import string

    parts: list[Column | str] = []
    for text, name, _, _ in string.Formatter().parse(pattern):
        if text:
            parts.append(text)
        if name is not None:
            parts.append(fields[name].cast("string"))
    return cat(*(parts or [""]))


Rows = Callable[[Column, Column], Column]
