"""Text functions as Catalyst expressions: trimming, folding, splitting, packing, quantities, answer parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip and re's \s see it: Unicode spaces plus the four separators U+001C-U+001F.
SPACE = "[\\s\\x1c-\\x1f]"
#: Flags under which a Java pattern behaves as a Python one: Unicode case and classes, and "." stops at \n only.
FLAGS = "(?iuUd)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+$", "")


def optional_text(c: Column) -> Column:
    """Stripped text; blank becomes null."""
    return F.nullif(strip(c), F.lit(""))


def fold_ascii(c: Column) -> Column:
    """Lower-case A-Z only: the key for case-insensitive equality that leaves other letters distinct."""
    return F.translate(c, _UPPER, _UPPER.lower())


def same_name(a: Column, b: Column) -> Column:
    return fold_ascii(a) == fold_ascii(b)


def _parts(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), strip), lambda x: x != "")


def split_units(c: Column, max_chars: int = 1200) -> Column:
    """Units no smaller than a sentence: paragraphs, else lines, else sentences of whatever exceeds max_chars.

    Null or blank text gives an empty array; a text within the limit is one unit.
    """
    if max_chars < 100:
        raise ValueError("max_chars must be at least 100")
    text = strip(F.coalesce(c, F.lit("")))
    paragraphs = _parts(text, f"(?U)\\n{SPACE}*\\n")

    def sentences(line: Column) -> Column:
        return _parts(line, f"(?U)(?<=[.!?]){SPACE}+(?=[A-ZÇĞİÖŞÜ0-9])")

    def of_line(line: Column) -> Column:
        return F.when(F.length(line) <= max_chars, F.array(line)).otherwise(sentences(line))

    def of_paragraph(p: Column) -> Column:
        return F.when(F.length(p) <= max_chars, F.array(p)).otherwise(F.flatten(F.transform(_parts(p, _LINE_BREAK), of_line)))

    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(F.length(text) <= max_chars, F.array(text))
        .otherwise(F.flatten(F.transform(paragraphs, of_paragraph)))
    )


def pack_units(units: Column, max_chars: int = 1200) -> Column:
    """Greedy first-fit-in-order packing; a unit longer than max_chars stays whole.

    Units are joined by a space, or by a blank line when either side holds a line break.
    """

    def step(acc: Column, unit: Column) -> Column:
        cur = acc["cur"]
        sep = F.when(F.contains(unit, F.lit("\n")) | F.contains(cur, F.lit("\n")), F.lit("\n\n")).otherwise(F.lit(" "))
        joined = F.when(cur == "", unit).otherwise(F.concat(cur, sep, unit))
        full = (cur != "") & (F.length(joined) > max_chars)
        return F.struct(
            F.when(full, F.array_append(acc["done"], cur)).otherwise(acc["done"]).alias("done"),
            F.when(full, unit).otherwise(joined).alias("cur"),
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
    return F.aggregate(units, start, step, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.array_append(a["done"], a["cur"])))


def split_text(c: Column, max_chars: int = 1200) -> Column:
    return pack_units(split_units(c, max_chars), max_chars)


def chunk_header(name: Column, kind: Column) -> Column:
    return F.concat(F.lit("İlaç: "), name, F.lit("\nKategori: "), kind, F.lit("\n"))


def chunk_body(c: Column) -> Column:
    """Text after the leading header lines (name, category), however many there are."""
    return F.regexp_replace(c, "(?iu)\\A(?:(?:ilaç:|i\\x{307}laç:|İlaç:|kategori:)[^\\n]*(?:\\n|\\z))+", "")


# The units a quantity may carry, and the spellings that mean the same unit.
QUANTITY_UNITS = (
    "mikrogram", "miligram", "gram", "mcg", "µg", "mg", "g", "mililitre", "ml", "tablet", "kapsül", "kapsul",
    "damla", "ölçek", "olcek", "doz", "saat", "gün", "gun", "hafta",
)
UNIT_ALIASES = {
    "mikrogram": "mcg", "µg": "mcg", "miligram": "mg", "gram": "g", "mililitre": "ml",
    "kapsul": "kapsül", "olcek": "ölçek", "gun": "gün",
}


def quantities(folded: Column, units: tuple[str, ...] = QUANTITY_UNITS, aliases: dict[str, str] | None = None) -> Column:
    """Array of "number unit" found in case-folded text: comma becomes a point, leading zeros go, units are aliased."""
    aliases = UNIT_ALIASES if aliases is None else aliases
    pattern = f"{FLAGS}\\b(\\d+(?:[.,]\\d+)?)[\\s\\x1c-\\x1f]*({'|'.join(units)})\\b"
    text = F.coalesce(folded, F.lit(""))
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("u")
    )
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None

    def norm(p: Column) -> Column:
        bare = F.regexp_replace(F.translate(p["n"], ",", "."), "^0+", "")
        unit = F.coalesce(F.try_element_at(table, p["u"]), p["u"]) if table is not None else p["u"]
        return F.concat(F.when(bare == "", F.lit("0")).otherwise(bare), F.lit(" "), unit)

    return F.transform(pairs, norm)


def unsupported(answer: Column, evidence: Column) -> Column:
    """Whether the answer states a quantity that the evidence does not."""
    return F.size(F.array_except(answer, evidence)) > 0


def split_response(c: Column, marker: str, no_source: str, disclaimer: str) -> Column:
    """Struct(answer, sources, disclaimer) of a finished response, cut at its last marker.

    Without a marker the whole text is the answer; blank sources and disclaimers take the given defaults.
    """
    tail = F.substring_index(c, marker, -1)
    has = F.contains(c, F.lit(marker))
    answer = F.substring(c, F.lit(1), F.length(c) - F.length(F.lit(marker)) - F.length(tail))
    two = F.split(tail, "\n\n", 2)
    return F.struct(
        strip(F.when(has, answer).otherwise(c)).alias("answer"),
        F.when(has, F.coalesce(optional_text(two[0]), F.lit(no_source))).otherwise(F.lit(no_source)).alias("sources"),
        F.when(has, F.coalesce(optional_text(F.get(two, F.lit(1))), F.lit(disclaimer))).otherwise(F.lit(disclaimer)).alias("disclaimer"),
    )
