"""Linking the spellings of names typed by people.

A typed product name is read into a brand and its marks (addition, strength, form); a typed ingredient into a base
and a salt. Spellings are merged into profiles in rounds. A profile is its centre, the spelling of the strongest, and
all spellings it took in. In every round profiles meet by blocking keys (a spelling with up to two letters left out); a
profile joins a stronger one if its centre lies within two edits of the other's centre, or of two of its spellings.
So merged profiles, which own more spellings, draw in what none of their spellings could alone, and two frequent
brands don't merge through a rare spelling between them. Rounds end when nothing merges.
Initials ("Hazuk." for Hazukson) join the profile that has a spelling they begin, among products of the same marks;
where none of those has one, the only profile of any marks that has. The marks they bring are the profile's from then
on, and initials are matched again until none joins. The rest join the only longest initials of the same marks that
begin like them. Initials that fit several stay apart, and edits within initials aren't matched.
"""

from __future__ import annotations

import re
import unicodedata as ud
import zlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kervan.llm.unicode_form import consistent
from kervan.session import cut

#: Edits (insertion, deletion, replacement, swap of neighbours) that spellings of one brand may lie apart.
EDITS = 2
#: Letters that initials must have; spellings shorter than SHORT may lie one edit apart only.
INITIALS, SHORT = 3, 6

# How forms, additions, units and salts are typed, after folding to plain lower-case letters.
FORMS = {
    "film tablet": r"film\s*kapli\s*(?:tablet|tabl|tab|tb|t)|film\s*-?\s*(?:tablet|tabl|tab|tb|t)|f\s*\.?\s*(?:tablet|tabl|tab|tb|t)",
    "tablet": r"tablet|tabl|tab|tb", "kapsul": r"kapsul|kaps|kap|kp", "krem": r"krem|kr", "damla": r"damla|daml|dml", "flakon": r"flakon|flak|flk",
    "ampul": r"ampul|amp", "sase": r"sase|sas|ss", "surup": r"surup|sur|srp", "merhem": r"merhem|mrh", "jel": r"jel", "sprey": r"sprey|spr", "fitil": r"fitil",
}
ADDITIONS = {"plus": r"plus|pls", "forte": r"forte|fort|frt", "retard": r"retard|ret|rtd", "junior": r"junior|jun|jr"}
GRAMS = {"g": 1000.0, "gr": 1000.0, "gram": 1000.0, "mcg": 0.001, "mikrogram": 0.001}
# Chemical signs of salts.
SALT_SIGNS = {"hcl": "hidroklorur", "so4": "sulfat", "po4": "fosfat", "k": "potasyum", "na": "sodyum"}

_PACK = re.compile(r"\(\s*\d+\s*(?:adet|tb|tablet)\s*\)|,?\s*\d+\s*['’]\s*l[iu]\b|\b\d+\s*(?:tb|tablet)\s*kutu\b|-?\s*\byeni\s+kutu\b|\b\d+\s*adet\b")
_STRENGTH = re.compile(r"(\d+(?:[.,]\d+)?)\s*(miligram|mikrogram|gram|mcg|mg|gr|ml|iu|g)\b\.?")
_FORM = [(k, re.compile(rf"(?<![a-z])(?:{p})\b\.?")) for k, p in FORMS.items()]
_ADD = [(k, re.compile(rf"(?<![a-z])(?:{p})\b\.?" + (r"|\+" if k == "plus" else ""))) for k, p in ADDITIONS.items()]


def fold(text: str) -> str:
    """Consistent form in plain lower-case letters, without marks; the Turkish dotted and dotless i are one letter."""
    flat = consistent(text)[0].translate(str.maketrans("İIı", "iii")).lower()
    return "".join(c for c in ud.normalize("NFD", flat) if not ud.combining(c))


def read_name(text: str | None) -> tuple[str, bool, str]:
    """(brand letters, whether they are initials, marks "addition|strength|form") of a typed product name; '' if blank."""
    if not text or not text.strip():
        return "", False, ""
    s = _PACK.sub(" ", fold(text))
    strength = ""
    m = _STRENGTH.search(s)
    if m:
        unit = m.group(2)
        value = float(m.group(1).replace(",", ".")) * GRAMS.get(unit, 1.0)
        strength = f"{value:g} {unit if unit in ('ml', 'iu') else 'mg'}"
        s = s[: m.start()] + " " + s[m.end() :]
    found = []
    for table in (_FORM, _ADD):
        # the brand is never read as a mark: a match may not be the only word left
        hit = next(((k, m) for k, p in table for m in p.finditer(s) if re.search(r"[a-z]{3}", s[: m.start()] + s[m.end() :])), None)
        found.append(hit[0] if hit else "")
        if hit:
            s = s[: hit[1].start()] + " " + s[hit[1].end() :]
    brand = re.sub(r"[^a-z0-9]", "", s)
    return brand, bool(re.search(r"[a-z]\.", s)), f"{found[1]}|{strength}|{found[0]}"


def distance(a: str, b: str, most: int) -> int:
    """Edits between two words, swaps of neighbours counted once; most + 1 where there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    older, old = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i, *[0] * len(b)]
        for j, y in enumerate(b, 1):
            now[j] = min(old[j] + 1, now[j - 1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                now[j] = min(now[j], older[j - 2] + 1)
        if min(now) > most:
            return most + 1
        older, old = old, now
    return old[-1]


def without(word: str, most: int = EDITS) -> list[str]:
    """The word and what is left of it without up to `most` letters: two words within `most` edits share one of these."""
    out, level = {word}, {word}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out |= level
    return sorted(out)


@F.pandas_udf(T.StructType([T.StructField("brand", T.StringType()), T.StructField("initials", T.BooleanType()), T.StructField("marks", T.StringType())]))
def _read(names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_name(n) for n in names], columns=["brand", "initials", "marks"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _keys(words: pd.Series) -> pd.Series:
    return pd.Series([without(w, EDITS if len(w) >= SHORT else 1) for w in words], dtype=object)


@F.pandas_udf(T.BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([(m := EDITS if min(len(x), len(y)) >= SHORT else 1) >= distance(x, y, m) for x, y in zip(a, b, strict=True)], dtype=bool)


def _merged(spelled: DataFrame, edges: DataFrame) -> DataFrame:
    """brand, label: spellings with the centre of the profile that took them in.

    spelled: brand, n (rows); edges: a, b, both ways, spellings within the allowed edits. In each round the profiles
    that have no stronger one beside them are centres; every other one joins the strongest centre beside it. Profiles
    beside none wait for the next round, in which the merged ones count with all their rows and spellings.
    """
    degree = edges.groupBy(F.col("a").alias("brand")).agg(F.count("*").alias("degree"))
    known = cut(spelled.join(degree, "brand", "left").select("brand", "n", F.coalesce("degree", F.lit(0)).alias("degree")))
    near = known.filter("degree > 0")
    profile = near.select("brand", F.col("brand").alias("label"))
    while True:
        rows = profile.join(near, "brand").groupBy("label").agg(F.sum("n").alias("n"), F.max(F.when(F.col("brand") == F.col("label"), F.col("degree"))).alias("degree"))
        strength = rows.select("label", F.struct("n", "degree", "label").alias("s"))
        mine, other = strength.select(F.col("label").alias("p"), F.col("s").alias("sp")), strength.select(F.col("label").alias("q"), F.col("s").alias("sq"))
        beside = edges.join(mine, F.col("a") == F.col("p")).join(profile.select(F.col("brand").alias("b"), F.col("label").alias("q")), "b").filter(F.col("p") != F.col("q"))
        beside = beside.groupBy("p", "q").agg(F.first("sp").alias("sp"), F.count("*").alias("spellings"), F.bool_or(F.col("b") == F.col("q")).alias("centre"))
        stronger = cut(beside.filter(F.col("centre") | (F.col("spellings") >= 2)).join(other, "q").filter(F.col("sq") > F.col("sp")).select("p", "q", "sq"))
        joins = stronger.join(stronger.select(F.col("p").alias("q")).distinct(), "q", "left_anti").groupBy("p").agg(F.max_by("q", "sq").alias("q"))
        if stronger.isEmpty():
            break
        profile = cut(profile.join(joins, F.col("label") == F.col("p"), "left").select("brand", F.coalesce("q", "label").alias("label")))
    return known.join(profile, "brand", "left").select("brand", F.coalesce("label", "brand").alias("label"))


def resolve_names(df: DataFrame, key: str, name: str) -> DataFrame:
    """key, product: one row per row of df whose name is filled, repeated rows once; rows of one product share the value.

    Null and blank names give no row. Names without letters of a brand are a product of their own marks. A product is
    brand profile and marks; how many rows, or copies of a name, one product has makes no difference to a task: rows
    are reduced to distinct spellings by an aggregation that combines before the shuffle.
    """
    rows = cut(df.select(F.col(key).alias("_key"), _read(F.col(name)).alias("_r")).select("_key", "_r.brand", "_r.initials", "_r.marks").filter(F.col("marks") != ""))
    spelled = cut(rows.groupBy("brand", "initials", "marks").agg(F.count("*").alias("n")))
    full = spelled.filter(~F.col("initials")).groupBy("brand").agg(F.sum("n").alias("n"))
    keyed = full.select("brand", F.explode(_keys("brand")).alias("_k"))
    near = keyed.alias("x").join(keyed.alias("y"), "_k").filter(F.col("x.brand") < F.col("y.brand")).select(F.col("x.brand").alias("a"), F.col("y.brand").alias("b")).distinct()
    one = cut(near.filter(_alike("a", "b")))
    profile = cut(_merged(full, one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b")))))
    prefixes = F.transform(F.sequence(F.lit(INITIALS), F.length("brand") - 1), lambda i: F.substring(F.col("brand"), F.lit(1), i))
    open_ = spelled.filter("initials").select(F.col("brand").alias("stem"), "marks").distinct()
    begun = cut(profile.filter(F.length("brand") > INITIALS).select("label", F.explode(prefixes).alias("stem")).join(open_.select("stem").distinct(), "stem", "left_semi").distinct())
    whole = begun.groupBy("stem").agg(F.min("label").alias("label"), F.count("*").alias("n")).filter("n = 1").select("stem", "label")
    products = spelled.filter(~F.col("initials")).join(profile, "brand").select("label", "marks").distinct()
    owner, open_ = None, cut(open_)
    while True:
        # a profile's spellings count wherever it has a product of those marks, be it by initials that joined before
        hits = cut(open_.join(begun, "stem").join(products, ["label", "marks"]).groupBy("stem", "marks").agg(F.min("label").alias("label"), F.count("*").alias("n")))
        anywhere = open_.join(hits, ["stem", "marks"], "left_anti").join(whole, "stem").select("stem", "marks", "label")
        found = cut(hits.filter("n = 1").select("stem", "marks", "label").unionByName(anywhere))
        if found.isEmpty():
            break
        owner = found if owner is None else owner.unionByName(found)
        products = cut(products.unionByName(found.select("label", "marks")).distinct())
        open_ = cut(open_.join(found.select("stem", "marks"), ["stem", "marks"], "left_anti"))
    # initials that begin no spelling: those that begin the only longest ones of the same marks are one with them
    lone = cut(open_.join(begun.select("stem").distinct(), "stem", "left_anti"))
    longer = cut(lone.select(F.col("stem").alias("brand"), "marks").filter(F.length("brand") > INITIALS).select("brand", "marks", F.explode(prefixes).alias("stem")).join(lone, ["stem", "marks"]))
    tops = longer.join(longer.select(F.col("stem").alias("brand"), "marks").distinct(), ["brand", "marks"], "left_anti")
    tops = tops.groupBy("stem", "marks").agg(F.min("brand").alias("brand"), F.count("*").alias("n")).filter("n = 1").select("stem", "marks", F.concat("brand", F.lit(".")).alias("label"))
    owner = tops if owner is None else owner.unionByName(tops)
    named = rows.filter(~F.col("initials")).join(profile, "brand").select("_key", F.concat_ws("|", "label", "marks").alias("product"))
    by_initials = rows.filter("initials").join(owner.withColumnRenamed("stem", "brand"), ["brand", "marks"], "left")
    by_initials = by_initials.select("_key", F.concat_ws("|", F.coalesce("label", F.concat("brand", F.lit("."))), "marks").alias("product"))
    return named.unionByName(by_initials).distinct().withColumnRenamed("_key", key)


# ---- ingredients ----


def sound(word: str) -> str:
    """A base as it sounds: ph and f, c, q and k, x and ks, z and s, y and i are one; a silent last e goes; letters don't double."""
    w = word.replace("ph", "f").replace("x", "ks").translate(str.maketrans("cqzy", "kksi"))
    w = re.sub(r"(.)\1+", r"\1", w)
    return w[:-1] if w.endswith("e") and len(w) > 4 else w


def known_salts(names: list[str]) -> tuple[str, ...]:
    """The last words of known (folded) names of several words: the salts after the bases."""
    return tuple(sorted({n.split()[-1] for n in names if len(n.split()) > 1}))


def read_ingredient(part: str, salts: tuple[str, ...]) -> tuple[str, str]:
    """(kind:base, salt) of one folded ingredient: a code, a common name with its number, or a base with its salt."""
    s = part.strip(" ()-")
    code = re.fullmatch(r"([a-z]{2,5})\s*-?\s*(\d{2,4})\.?", s)
    if code:
        return f"code:{code.group(1)}{code.group(2)}", ""
    common = re.fullmatch(r"([a-z]{3,8})[\s-]+([a-z]\s*\d{1,3})\.?", s)
    if common:
        return f"name:{common.group(1)} {common.group(2).replace(' ', '')}", ""
    base, salt = [], ""
    for raw in re.findall(r"[a-z0-9]+\.?", s):
        w = raw.rstrip(".")
        if SALT_SIGNS.get(w) in salts:
            salt = SALT_SIGNS[w]
        elif raw.endswith(".") and len(w) >= 2 and (fits := [x for x in salts if x.startswith(w)]):
            salt = fits[0]
        elif len(w) >= 4 and (fits := sorted((d, x) for x in salts if (d := distance(w, x, 2)) <= 2)):
            salt = fits[0][1]
        else:
            base.append(w)
    return f"base:{''.join(base)}", salt


class Ingredients:
    """Known ingredients, ready to be looked up by any spelling: all of them, or those of one part of the bases."""

    #: Ingredients that a worker holds at once.
    LIMIT = 100_000

    def __init__(self, refs: list[tuple[int, str, str | None, str | None]], salts: tuple[str, ...]):
        self.exact: dict[str, int] = {}
        self.near: dict[str, set[str]] = {}
        self.salts: dict[str, dict[str, int]] = {}
        self.names: dict[str, list[tuple[str, int]]] = {}
        self.known = salts
        for i, name, common, code in refs:
            base, salt = known_base(name, salts)
            self.salts.setdefault(base, {}).setdefault(salt, i)
            for w in without(base):
                self.near.setdefault(w, set()).add(base)
            for text in (common, code):
                if text:
                    k, _ = read_ingredient(fold(text), salts)
                    self.exact[k] = i
                    if k.startswith("name:"):
                        word, number = k[5:].split(" ")
                        self.names.setdefault(number, []).append((word, i))

    @lru_cache(200_000)  # noqa: B019
    def candidate(self, part: str) -> tuple[int, int, str, int | None] | None:
        """(rank, edits, tie, ingredient or None) of what a folded part names best here, None where it names nothing; the
        least is the best of several parts of the table. A salt that isn't known of its base names nothing; a base typed
        without one names its only ingredient, if there is but one."""
        kind, salt = read_ingredient(part, self.known)
        if kind in self.exact:
            return 0, -self.exact[kind], "", self.exact[kind]
        if kind.startswith("name:"):
            word, number = kind[5:].split(" ")
            fits = min(((d, i) for w, i in self.names.get(number, ()) if (d := distance(word, w, 2)) <= 2), default=None)
            return fits and (2, fits[0], f"{fits[1]:020}", fits[1])
        if not kind.startswith("base:"):
            return None
        base = sound(kind[5:])
        if base in self.salts:
            return 1, 0, base, self._salted(base, salt)
        if len(base) < 5:
            return None
        fits = min(((d, b) for b in {b for w in without(base) for b in self.near.get(w, ())} if (d := distance(base, b, EDITS)) <= EDITS), default=None)
        return fits and (2, *fits, self._salted(fits[1], salt))

    def find(self, part: str) -> int | None:
        found = self.candidate(part)
        return found[3] if found else None

    def _salted(self, base: str, salt: str) -> int | None:
        known = self.salts[base]
        return next(iter(known.values())) if not salt and len(known) == 1 else known.get(salt)


def known_base(name: str | None, salts: tuple[str, ...]) -> tuple[str, str]:
    """(base as it sounds, salt) of a known ingredient's name."""
    kind, salt = read_ingredient(fold(name or ""), salts)
    return sound(kind[5:]), salt


_SEPARATOR = re.compile(r"[/,+;&|]|\bve\b|\band\b|\bund\b")


def parts_of(value: str) -> list[str]:
    """The folded parts of a value that may name an ingredient each."""
    return [p.strip() for p in _SEPARATOR.split(fold(value)) if p.strip()]


def link_ingredients(df: DataFrame, key: str, text: str, refs: DataFrame) -> DataFrame:
    """key, ingredient_id: one row per known ingredient a value names, however spelled; each once.

    refs: ingredient_id, ingredient_name, common_name, short_code. Null and blank values, and ingredients that aren't
    known, give no row. Values are reduced to distinct ones before they are read. Up to Ingredients.LIMIT known
    ingredients travel to the workers at once; more are looked up in as many passes as it takes, split by their bases,
    and the best of all passes counts, which is what one pass over all would give.
    """
    spark = df.sparkSession
    table = refs.select("ingredient_id", "ingredient_name", "common_name", "short_code")
    passes = -(-max(1, table.count()) // Ingredients.LIMIT)
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_v")).filter(F.trim("_v") != "")
    values = rows.groupBy("_v").agg(F.count("*").alias("_n")).select("_v")

    @F.pandas_udf(T.StringType())
    def salt_word(names: pd.Series) -> pd.Series:
        return pd.Series([next(iter(known_salts([fold(n)])), None) if n else None for n in names], dtype=object)

    salts = tuple(sorted(r[0] for r in table.select(salt_word("ingredient_name")).distinct().collect() if r[0]))  # words, not ingredients

    @F.pandas_udf("bigint")
    def pass_of(names: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(known_base(n, salts)[0].encode()) % passes for n in names])

    def held(no: int):
        mine = table if passes == 1 else table.filter(pass_of("ingredient_name") == no)
        return spark.sparkContext.broadcast(Ingredients([tuple(r) for r in mine.orderBy("ingredient_id").collect()], salts))

    if passes == 1:
        known = held(0)

        @F.pandas_udf("array<bigint>")
        def find(values: pd.Series) -> pd.Series:
            k = known.value
            return pd.Series([sorted({i for p in parts_of(v) if (i := k.find(p)) is not None}) for v in values], dtype=object)

        named = values.select("_v", find("_v").alias("_ids"))
    else:

        @F.pandas_udf("array<string>")
        def cut_up(values: pd.Series) -> pd.Series:
            return pd.Series([parts_of(v) for v in values], dtype=object)

        asked = cut(values.select("_v", F.explode(cut_up("_v")).alias("_part")))
        parts, found = cut(asked.select("_part").distinct()), None
        for no in range(passes):
            known = held(no)

            @F.pandas_udf("struct<rank:int,edits:bigint,tie:string,id:bigint>")
            def look(parts: pd.Series) -> pd.DataFrame:
                k = known.value
                return pd.DataFrame([k.candidate(p) or (None, None, None, None) for p in parts], columns=["rank", "edits", "tie", "id"]).astype(object)

            best = cut(parts.select("_part", look("_part").alias("_c")).filter(F.col("_c.rank").isNotNull()))
            found = best if found is None else found.unionByName(best)
        chosen = found.groupBy("_part").agg(F.min("_c").alias("_c"))
        named = asked.join(chosen, "_part").filter(F.col("_c.id").isNotNull()).groupBy("_v").agg(F.collect_set("_c.id").alias("_ids"))
    return rows.join(named, "_v").select(F.col("_key").alias(key), F.explode("_ids").alias("ingredient_id")).distinct()
