"""One consistent form for text that looks alike but is stored with other characters.

Quick-check properties mark the characters that may be unstable: those a normalisation form changes or composes,
those that are invisible, and those that stand in for another. Only runs of such characters, with the boundary
characters they may combine with, are normalised; the results are spliced into the untouched rest. A pattern of
plainly stable characters passes most values at once; only values that change travel back from the worker.
"""

from __future__ import annotations

import re
import unicodedata as ud
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A value of these characters alone is in the consistent form.
PLAIN = "\\x20-\\x7e\\t\\n\\rçğıöşüÇĞİÖŞÜâîûÂÎÛäÄßéèàáíóúñ½²³¹®°≥≤±×µμ€§“”‘’„«»…–—•·"

# Letters of other scripts, and other Latin letters, with the ordinary letter each looks like.
LOOK_ALIKE = dict(
    zip(
        "аеіорсухѕјһԁԛԝѵүӏӀАВЕКМНОРСТУХІЈЅҮԚԜѴ" + "οναιρυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳ" + "օսհոցզՕՍ" + "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ",
        "aeiopcyxsjhdqwvylIABEKMHOPCTYXIJSYQWV" + "ovaipukABEZHIKMNOPTYXcj" + "ouhngqOU" + "ABCDEGHJKLMPRSTVWZ",
        strict=True,
    )
)
LATIN_LOOK_ALIKE = dict(zip("ɡɑșȘǧǦɩ", "gaşŞğĞi", strict=True))
HYPHENS = "\u2010\u2011\u2212\ufe63\uff0d"
#: Blank characters other than the plain space.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Compatibility characters that ordinary writing uses or that look unlike their decomposition.
_KEEP = set("…‥№µ¨¯´¸ªº")
_KEEP_TAGS = {"<super>", "<sub>", "<fraction>", "<circle>"}
_JOINERS = "\u200c\u200d"
#: Blocks of the scripts whose letters stand in for Latin ones: Greek, Cyrillic, Armenian, Cherokee.
_FOREIGN = "\u0370-\u03ff\u0400-\u052f\u0531-\u0587\u13a0-\u13f5\uab70-\uabbf"
_DOT = "\u0307"


def _is_invisible(ch: str) -> bool:
    return ch in "\u034f\u115f\u1160\u3164\uffa0\u180b\u180c\u180d\u180f" or "\ufe00" <= ch <= "\ufe0f" or "\U000e0100" <= ch <= "\U000e01ef" or (ud.category(ch) in ("Cf", "Cc") and ch not in "\t\n\r\u0600\u0601\u0602\u0603\u0604\u0605\u06dd")


def _small_capitals() -> dict[str, str]:
    """Small capitals with the letter each is drawn like, from their names."""
    names = ((chr(cp), ud.name(chr(cp), "")) for cp in (*range(0x250, 0x2B0), *range(0x1D00, 0x1D80), *range(0xA720, 0xA800)))
    return {ch: n[-1].lower() for ch, n in names if re.fullmatch("LATIN LETTER SMALL CAPITAL [A-Z]", n)}


@lru_cache(1)
def _tables() -> tuple[dict[str, str], str]:
    """(fold of single characters, class of unstable characters), from the Unicode data itself.

    Unstable are, besides what is folded or invisible, the characters whose quick check for the composed form isn't
    "yes": marks, what another stored form stands for, and whatever ends a canonical pair, marks or not.
    """
    fold: dict[str, str] = {c: " " for c in SPACES} | {c: "-" for c in HYPHENS} | _small_capitals() | LATIN_LOOK_ALIKE
    unstable = {*fold, *map(chr, range(0x1161, 0x1176)), *map(chr, range(0x11A8, 0x11C3))}  # the jamo that compose by rule
    for cp in (*range(0xA0, 0x30000), *range(0xE0000, 0xE0200)):
        ch = chr(cp)
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3:
            continue
        if _is_invisible(ch):
            unstable.add(ch)
            continue
        d = ud.decomposition(ch)
        if ud.combining(ch):
            unstable.add(ch)
        if not d or ch in fold or ch in _KEEP:
            continue
        if not d.startswith("<"):
            if ud.normalize("NFC", ch) != ch:
                unstable.add(ch)
            elif " " in d:
                unstable.add(chr(int(d.split()[1], 16)))
        elif d.split()[0] not in _KEEP_TAGS and not 0x0E00 <= cp <= 0x0FFF and not 0x3130 <= cp <= 0x318F:
            flat = ud.normalize("NFKC", ch)
            if not flat.startswith(" ") and flat != ch:
                fold[ch] = flat
                unstable.add(ch)
    for cp in (*range(0x20), *range(0x7F, 0xA0)):
        if chr(cp) not in "\t\n\r":
            unstable.add(chr(cp))
    return fold, _char_class(unstable)


def _char_class(chars: set[str]) -> str:
    cps, out = sorted(map(ord, chars)), []
    while cps:
        j = 0
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        out.append(f"\\U{cps[0]:08x}" + (f"-\\U{cps[j]:08x}" if j else ""))
        cps = cps[j + 1 :]
    return "[" + "".join(out) + "]"


@lru_cache(1)
def _patterns():
    fold, unstable = _tables()
    segment = re.compile(f"(?:(?=[^{PLAIN}]){unstable})+")
    return fold, segment, re.compile(f"[{_FOREIGN}]")


_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}、。〈-】〔-〛]")
_JOINING = regex.compile(r"[\p{Arabic}\p{Devanagari}\p{Bengali}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Gujarati}\p{Gurmukhi}\p{Sinhala}\p{Khmer}\p{Thai}\p{Syriac}\p{Mongolian}]")
_EMOJI = regex.compile(r"\p{Extended_Pictographic}|[\U0001f3fb-\U0001f3ff⃣]")
_UNIT = regex.compile(r"(?:[gGlLmMsW]|mol|kat|IU|Ci|Sv|mL|gr|eq|U)\w{0,2}\Z")


def _near(text: str, i: int, step: int) -> bool:
    """Whether the next letter that way, over blanks, digits, quotes and marks, belongs to East Asian writing."""
    i += step
    while 0 <= i < len(text) and not text[i].isalpha() and not _CJK.match(text[i]):
        i += step
    return 0 <= i < len(text) and bool(_CJK.match(text[i]))


def _segment(text: str, start: int, end: int, fold: dict[str, str]) -> tuple[str, bool]:
    """Canonical form of text[start:end] in its context, and whether a look-alike or invisible character was in it."""
    out, found = [], False
    for i in range(start, end):
        ch = text[i]
        if ch in fold:
            if ch == "\u3000" and _near(text, i, -1) and _near(text, i, 1) or 0xFF01 <= ord(ch) <= 0xFF60 and not fold[ch].isalnum() and (_near(text, i, -1) or _near(text, i, 1)):
                out.append(ch)  # punctuation and blanks of East Asian writing
            else:
                out.append(fold[ch])
                found = True
        elif _is_invisible(ch):
            before, after = text[i - 1 : i], text[i + 1 : i + 2]
            own = (ch in _JOINERS and (_JOINING.match(before) or _EMOJI.match(before) and _EMOJI.match(after))) or ("︀" <= ch <= "️" and _EMOJI.match(before))
            own = own or "\U000e0100" <= ch <= "\U000e01ef" and _CJK.match(before)  # the variant of an ideograph
            own = own or "\U000e0020" <= ch <= "\U000e007f" and out and (out[-1] == "\U0001f3f4" or "\U000e0020" <= out[-1] <= "\U000e007f")  # the letters of a flag
            if own:
                out.append(ch)
            else:
                found = True
        else:
            out.append(ch)
    piece = "".join(out)
    composed = ud.normalize("NFC", piece)
    if len(composed) < len(piece) or any(ud.combining(c) == 0 and c not in piece for c in composed):
        found = True
    if any(c in LATIN_LOOK_ALIKE for c in composed):  # made by the composition
        composed, found = ud.normalize("NFC", "".join(LATIN_LOOK_ALIKE.get(c, c) for c in composed)), True
    if _DOT in composed and "i" + _DOT in composed:
        composed, found = composed.replace("i" + _DOT, "i"), True
    return composed, found


_LATIN = regex.compile(r"\p{Latin}")
_LATIN_WORD = regex.compile(r"\p{Latin}{2,}")
_GREEK = regex.compile(r"\p{Greek}")
_OWN = re.compile(f"[{_FOREIGN}]{{2,}}")
#: Greek letters that stand as symbols before a Latin letter or alone, as in "β1" or "μg".
_SYMBOLS = "αβγδεκλμπσω"


def _is_letter(ch: str) -> bool:
    return ch.isalpha() or "\u0300" <= ch <= "\u036f"


def _words(text: str, foreign) -> tuple[str, bool]:
    """Latin letters for look-alikes inside words that are otherwise Latin, or that stand alone among Latin words."""
    parts, at, own = [], 0, None
    m = foreign.search(text)
    while m:
        i, j = m.start(), m.end()
        while i > at and _is_letter(text[i - 1]):
            i -= 1
        while j < len(text) and _is_letter(text[j]):
            j += 1
        m, w = foreign.search(text, j), text[i:j]
        flat = ud.normalize("NFD", w)
        if w[0] == "μ" and _UNIT.match(w[1:]) or not any(c in LOOK_ALIKE for c in flat):
            continue
        if not _LATIN.search(w):
            if any(c not in LOOK_ALIKE for c in w) or (len(w) == 1 and _GREEK.match(w) and (w.islower() or text[j : j + 1] == "-")):
                continue
            if own is None:  # words of the script itself, which no look-alikes make up
                own = any(any(c not in LOOK_ALIKE for c in x) for x in _OWN.findall(text))
            if own or not _LATIN_WORD.search(text):
                continue
        elif len(w) == 2 and w[0] in _SYMBOLS:
            continue
        parts += [text[at:i], ud.normalize("NFC", "".join(LOOK_ALIKE.get(c, c) for c in flat))]
        at = j
    return "".join([*parts, text[at:]]), bool(parts)


def consistent(text: str | None) -> tuple[str | None, bool]:
    """(consistent form, whether the value holds a disguised or invisible character); null stays null, '' stays ''."""
    if not text:
        return text, False
    fold, segment, foreign = _patterns()
    parts, at, found = [], 0, False
    for m in segment.finditer(text):
        start = max(at, m.start() - (m.start() > at and not text[m.start() - 1].isspace()))  # the character it may compose with
        piece, hit = _segment(text, start, m.end(), fold)
        parts += [text[at:start], piece]
        at, found = m.end(), found or hit
    flat = "".join([*parts, text[at:]]) if parts else text
    if foreign.search(flat):
        flat, hit = _words(flat, foreign)
        found = found or hit
    return flat, found


_UNPLAIN = re.compile(f"[^{PLAIN}]")


def form_in_worker(text: str) -> str:
    """The consistent form, for functions that hold the text already."""
    return consistent(text)[0] if _UNPLAIN.search(text) else text


_FORM = T.StructType([T.StructField("form", T.StringType()), T.StructField("disguised", T.BooleanType())])


@F.pandas_udf(_FORM)
def _form(texts: pd.Series) -> pd.DataFrame:
    """The form where it differs from the value, so that only such values travel back, and whether the value was disguised."""
    rows = []
    for t in texts:
        form, hit = consistent(t) if t is not None and _UNPLAIN.search(t) else (t, False)
        rows.append((None if form == t else form, hit))
    return pd.DataFrame(rows, columns=["form", "disguised"])


def with_form(df: DataFrame, text: str, form: str = "form", disguised: str = "disguised") -> DataFrame:
    """df plus the consistent form of a text column and whether the stored value differs from ordinary writing.

    Null gives (null, false), '' gives ('', false). Repeated rows and other columns are kept; a column of the result's
    names is replaced. Form is idempotent.
    """
    out = df.withColumn("_form", _form(F.col(text)))
    return out.withColumns({form: F.coalesce("_form.form", F.col(text)), disguised: F.col("_form.disguised")}).drop("_form")


def form_of(c: Column) -> Column:
    """The consistent form as a column expression."""
    return F.coalesce(_form(c)["form"], c)
