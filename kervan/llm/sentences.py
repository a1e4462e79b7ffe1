"""Sentence boundaries by a finite transducer over character classes.

The rules are compiled once into a table state x class -> (state, action). A character can only mark a possible end
(action MARK), and a later one confirms it (action END, at the last mark) or breaks at once (action BREAK, a line
end). Long values are cut into blocks: a block is first run from every state at once, which gives a function from
states to states; the functions are composed by a parallel prefix scan, and each block is then run from its true state.
"""

from __future__ import annotations

import unicodedata as ud
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kervan.session import cut, task_slots

#: Code points of a block, and blocks of a group; values up to one block are run in one go.
BLOCK, GROUP = 2_048, 256

# Words that a full stop shortens and no sentence ends with, as typed and in lower case.
ABBREVIATIONS = (
    "dr", "prof", "doç", "uzm", "ecz", "bkz", "no", "ör", "yakl", "sn", "av", "md", "bl", "şek", "tbl", "mr", "mrs", "ms", "st", "vs", "fig", "sect",
    "approx", "eq", "cf", "al", "abschn", "bzw", "ca", "vgl", "hr", "fr", "nr", "abb", "см", "рис", "табл", "стр", "гл", "βλ", "σελ", "αρ", "κ", "डॉ", "د", "أ",
)

NONE, MARK, END, BREAK = 0, 1, 2, 3
_CLOSE = set("\"'”’»›“‘」』）)]｣")
_OPEN = set("\"'“„«‹‘「『（([”")
_COMMA = set(",，、;:،؛؛")
_CJK_END = set("。！？｡")
_HARD = set("।॥۔؟")
_BREAKS = set("\n\r\x0b\x0c\x85\u2028\u2029")


@lru_cache(1)
def _trie() -> tuple[dict, dict]:
    """(node, letter) -> node of the abbreviations, and the nodes that end one. Node 0 is the root."""
    step, ends, n = {}, {}, 1
    for word in ABBREVIATIONS:
        at = 0
        for ch in word:
            if (at, ch) not in step:
                step[at, ch] = n
                n += 1
            at = step[at, ch]
        ends[at] = True
    return step, ends


def _class(ch: str) -> str:
    """Class of a character: what the rules look at, as a short name."""
    if ch in _BREAKS:
        return "break"
    if ch.isspace():
        return "space"
    if ch in ".．":
        return "dot"
    if ch == "…":
        return "dots"
    if ch in "!?":
        return "bang"
    if ch in _CJK_END:
        return "cjk"
    if ch in _HARD:
        return "hard"
    if ch == ";":
        return "semi"
    if ch in _COMMA:
        return "comma"
    if ch == "と":
        return "to"
    if ch in ")]）":
        return "paren"
    if ch == "“":
        return "turned"  # opens in most writing, closes in German
    if ch in _CLOSE or ch in _OPEN:
        return "quote" if ch not in "([（「『„" else "open"
    cat = ud.category(ch)
    if cat == "Nd" or cat in ("No", "Nl"):
        return "digit"
    if 0x0E00 <= ord(ch) <= 0x0E7F:
        return "thai"
    if cat[0] == "M":
        return "mark"
    if cat[0] == "L":
        name = "greek" if 0x370 <= ord(ch) <= 0x3FF else "latin"
        low = ch.lower()
        kind = "upper" if ch != low or cat in ("Lu", "Lt") else "lower" if cat == "Ll" or ch.upper() != ch else "plain"
        if any(low[:1] == k[1] for k in _trie()[0]) or low in ("p", "h", "g"):
            return f"{kind}:{name}:{low[:1]}"
        return f"{kind}:{name}:"
    return "bullet" if ch in "-•*–—◦▪" else "other"


# State: (phase, ...). ("text", node, length 0-2, kind, flags) inside a sentence, where kind tells the last token:
# "" none, "w" word, "m" letters with digits, "n" number, "l" number that opens a line; flags: g last letter Greek, t last character Thai,
# v the token before this one was a number. ("end", why, closed, spaced, p) after a mark, waiting for what follows.
_START = ("text", 0, 0, "", False, False, False, True)


def _step(state: tuple, cls: str) -> tuple[tuple, int]:
    """One move; reads nothing but the state and the class."""
    if cls == "break":
        return _START, BREAK
    if state[0] == "end":
        return _after(state, cls)
    _, node, size, kind, greek, thai, number, opening = state
    part = cls.split(":")
    if len(part) == 3:
        trie, _ = _trie()
        fresh = kind not in ("w", "m") or size == 0
        nxt = trie.get((0 if fresh else node, part[2]), -1) if fresh or node >= 0 else -1
        if kind == "n" and size and not fresh:
            nxt = -1
        before = (kind == "n" or number) if fresh else number
        return ("text", nxt, 1 if fresh else 2, "w", part[1] == "greek", False, before, False), NONE
    if cls == "mark":
        return ("text", node, size, kind, greek, thai, number, opening), NONE
    if cls == "thai":
        return ("text", -1, 2, "w", False, True, False, False), NONE
    if cls == "digit":
        if kind in ("w", "m") and size:
            return ("text", -1, 2, "m", False, False, False, False), NONE
        return ("text", 0, 1, "l" if opening or kind == "l" else "n", False, False, False, opening), NONE
    if cls == "space":
        if thai:
            return ("end", "thai", False, True, 0), MARK
        # a token is over; whether it was a number still matters for a unit that follows
        return ("text", 0, 0, kind if kind == "n" else "", False, False, kind == "n", opening and kind == ""), NONE
    if cls == "dot":
        if kind in ("n", "l") and size:
            return ("end", "list" if kind == "l" else "num", False, False, 0), MARK
        if kind == "w" and size:
            short = (node >= 0 and _trie()[1].get(node, False)) or (size == 1 and not number)
            return ("end", "short" if short else "word", False, False, 0), MARK
        return ("end", "mixed" if kind == "m" and size else "word", False, False, 0), MARK
    if cls == "dots":
        return ("end", "word", False, False, 0), MARK
    if cls in ("bang", "hard"):
        return ("end", cls, False, False, 0), MARK
    if cls == "cjk":
        return ("end", "cjk", False, False, 0), MARK
    if cls == "semi" and greek:
        return ("end", "bang", False, False, 0), MARK
    keep = opening and cls in ("bullet", "quote", "turned", "open")
    return ("text", 0, 0, "", False, False, False, keep), NONE


def _begin(cls: str) -> tuple:
    """State after the first character of a new sentence."""
    return _step(_START[:-1] + (False,), cls)[0]


def _after(state: tuple, cls: str) -> tuple[tuple, int]:
    _, why, closed, spaced, p = state
    if why == "mixed":  # letters with digits: a word, unless a digit follows at once
        if cls == "digit" and not spaced and not closed:
            return ("text", -1, 2, "m", False, False, False, False), NONE
        why = "word"
    inside = ("text", 0, 0, "", False, False, False, False)
    part = cls.split(":")
    if p:  # "pH" opens a sentence though it is written small
        if len(part) == 3 and part[0] == "upper" and part[2] == "h":
            return ("text", -1, 2, "w", False, False, False, False), END
        return _step(("text", -1, 1, "w", False, False, False, False), cls)
    if cls == "space":
        return ("end", why, closed, True, 0), NONE
    if not spaced:
        if cls in ("dot", "dots", "bang", "hard", "cjk") or (cls == "semi" and why == "bang"):
            new = why if cls in ("dot", "dots") and why not in ("num", "list", "short") else "word" if cls in ("dot", "dots") else cls
            return ("end", "cjk" if why == "cjk" else new, closed, False, 0), MARK
        if cls == "turned" and why == "cjk":
            return _begin(cls), END
        if cls in ("quote", "paren", "turned"):
            if cls == "paren" and not closed and why in ("short", "num", "list"):
                return _step(inside, cls)
            return ("end", why, True, False, 0), MARK
        if why == "cjk":
            if cls == "comma" or (cls == "to" and closed):
                return inside, NONE
            return _begin(cls), END
        if cls == "digit":
            if why in ("num", "list", "short"):
                return _step(("text", 0, 0, "n" if why in ("num", "list") else "", False, False, False, False), cls)
            return _begin(cls), END
        if len(part) == 3:
            if part[0] == "upper" and why in ("word", "bang", "hard"):
                return _begin(cls), END
            if part[0] == "plain" and why in ("bang", "hard") or part[0] == "plain" and why == "word" and not closed:
                return _begin(cls), END
            return _step(inside, cls)
        if cls in ("thai", "to") and why in ("word", "bang", "hard"):
            return _begin(cls), END
        if cls == "open" and why in ("word", "bang", "hard"):
            return _begin(cls), END
        return _step(inside, cls)
    # blanks came between
    if cls in ("comma", "paren", "semi", "dot", "dots", "bang"):
        return _step(inside, cls)
    if why == "thai":
        return _begin(cls), END
    if why == "cjk":
        return _begin(cls), END
    if len(part) == 3 and part[0] == "lower":
        if part[2] == "p" and why in ("word", "bang", "hard", "num") and part[1] == "latin":
            return ("end", why, closed, spaced, 1), NONE
        return _step(inside, cls)
    if why in ("short", "list") and not closed:
        return _step(("text", 0, 0, "", False, False, False, why == "list"), cls) if cls != "digit" else _step(inside, cls)
    if why == "num" and not closed and len(part) == 3 and part[0] == "upper":
        return _step(inside, cls)
    if cls == "open" and why == "num":
        return _step(inside, cls)
    return _begin(cls), END


@lru_cache(1)
def transducer() -> tuple[dict[str, int], np.ndarray, np.ndarray, int]:
    """(class of a character seen so far, next states, actions, start): the compiled table."""
    classes = sorted({_class(chr(c)) for c in range(0x3000 + 0x100)} | {"cjk", "comma", "paren", "open", "to", "plain:latin:"})
    at, todo, rows = {_START: 0}, [_START], []
    while todo:
        s = todo.pop(0)
        row = []
        for c in classes:
            n, act = _step(s, c)
            if n not in at:
                at[n] = len(at)
                todo.append(n)
            row.append((at[n], act))
        rows.append(row)
    t = np.array(rows, np.int32)
    return {c: i for i, c in enumerate(classes)}, t[:, :, 0], t[:, :, 1], 0


class _Codes(dict):
    """Code point -> class number, filled as characters come up."""

    def __init__(self, index: dict[str, int]):
        super().__init__()
        self._index = index

    def __missing__(self, ch: str) -> int:
        self[ch] = k = self._index[_class(ch)]
        return k


@lru_cache(1)
def _machine():
    index, nxt, act, start = transducer()
    return _Codes(index), nxt.tolist(), act.tolist(), start, nxt


def run(text: str, state: int = 0) -> tuple[int, list[int], int]:
    """(end state, cuts, last mark) of one block: a cut is a position in it, or -1 for the last mark before it."""
    codes, nxt, act, _, _ = _machine()
    cuts, mark, i = [], -1, 0
    for ch in text:
        c = codes[ch]
        a = act[state][c]
        state = nxt[state][c]
        i += 1
        if a:
            if a == MARK:
                mark = i
            elif a == END:
                cuts.append(mark)
            else:
                cuts.append(i - 1)
                mark = -2  # nothing before a line end can be cut later
    return state, cuts, mark


def block_function(text: str) -> np.ndarray:
    """Where a block leads from every state: the composition of its characters' moves. States that have met stay one."""
    codes, step, _, _, nxt = _machine()
    f = np.arange(len(nxt))
    kept, place = list(range(len(nxt))), f
    for i, ch in enumerate(text):
        c = codes[ch]
        kept = [step[s][c] for s in kept]
        if i % 16 == 0 and len(kept) > 1:
            kept, where = np.unique(kept, return_inverse=True)
            kept, place = kept.tolist(), where[place]
    return np.asarray(kept)[place]


def compose(functions: list[np.ndarray]) -> list[np.ndarray]:
    """Prefix compositions (Hillis-Steele scan): the k-th leads from the start of the first block to the end of the k-th."""
    out, d = list(functions), 1
    while d < len(out):
        out = [out[i] if i < d else out[i][out[i - d]] for i in range(len(out))]
        d *= 2
    return out


def spans(text: str, cuts: list[int]) -> list[tuple[int, int]]:
    """(start, end) of the sentences between cuts, without surrounding white space; blank ones give none."""
    out, at = [], 0
    for c in [*cuts, len(text)]:
        piece = text[at:c]
        bare = piece.strip()
        if bare:
            s = at + len(piece) - len(piece.lstrip())
            out.append((s, s + len(bare)))
        at = max(at, c)
    return out


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Sentences of a value; null and blank ones have none."""
    if not text:
        return []
    return spans(text, run(text)[1])


_SPANS = "array<struct<start_pos:bigint,end_pos:bigint>>"


def split_sentences(df: DataFrame, text: str, keys: list[str], block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """keys, start_pos, end_pos: one row per sentence of every value, in code points; null and blank values give none.

    A repeated row gives its sentences again, null keys are keys like others; columns of any name don't matter. Values
    above `block` are run block by block on different workers. The block functions are composed by a scan in two
    steps: within groups of `group` blocks, side by side, and over the groups; no task holds more than `group`
    functions of a value, or one function per group. Sentences that reach over blocks are put together from the first
    and last character that each block sees of them, so no task needs the whole value.
    """
    rows = df.select(F.struct(*keys).alias("_keys"), F.col(text).alias("_t")).filter(F.col("_t").isNotNull())
    names = [F.col("_keys")[k].alias(k) for k in keys]

    @F.pandas_udf(_SPANS)
    def whole(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start_pos": a, "end_pos": b} for a, b in sentence_spans(t)] for t in texts], dtype=object)

    short = rows.filter(F.length("_t") <= block).select("_keys", F.inline(whole("_t"))).select(*names, "start_pos", "end_pos")
    long = rows.filter(F.length("_t") > block).withColumn("_row", F.monotonically_increasing_id())
    long = long.select("_keys", "_row", F.posexplode(F.regexp_extract_all("_t", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))).alias("_i", "_b"))
    long = cut(long.repartition(task_slots(df.sparkSession), "_row", "_i"))

    @F.pandas_udf("array<int>")
    def function(blocks: pd.Series) -> pd.Series:
        return pd.Series([block_function(b).astype(np.int32) for b in blocks], dtype=object)

    @F.pandas_udf("array<array<int>>")
    def scanned(functions: pd.Series) -> pd.Series:
        """Prefix compositions; the first is the identity, the last that of all."""
        out = []
        for fs in functions:
            done = compose([np.asarray(f) for f in fs])
            out.append([np.arange(len(done[0]), dtype=np.int32), *(f.astype(np.int32) for f in done)])
        return pd.Series(out, dtype=object)

    def prefixes(d: DataFrame, by: list[str], at: str, f: str) -> DataFrame:
        listed = d.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("i"), F.col(f).alias("f")))).alias("_all"))
        return listed.select(*by, F.col("_all.i").alias("_at"), scanned("_all.f").alias("_fs"))

    inner = cut(prefixes(long.select("_row", "_i", F.floor(F.col("_i") / group).alias("_g"), function("_b").alias("_f")), ["_row", "_g"], "_i", "_f"))
    outer = prefixes(inner.select("_row", "_g", F.element_at("_fs", -1).alias("_f")), ["_row"], "_g", "_f")
    entry = outer.select("_row", F.inline(F.arrays_zip(F.col("_at").alias("_g"), F.transform("_fs", lambda f: f[0]).alias("_s"))))  # state in which each group begins; one more than there are groups
    states = inner.join(entry.filter(F.col("_g").isNotNull()), ["_row", "_g"]).select("_row", F.inline(F.arrays_zip(F.col("_at").alias("_i"), F.transform("_fs", lambda f: F.get(f, F.col("_s"))).alias("_s"))))

    @F.pandas_udf("struct<cuts:array<bigint>,mark:bigint>")
    def emit(blocks: pd.Series, start: pd.Series, offset: pd.Series) -> pd.DataFrame:
        out = []
        for b, s, o in zip(blocks, start, offset, strict=True):
            _, cuts, mark = run(b, int(s))
            out.append(([c if c < 0 else c + o for c in cuts], mark if mark < 0 else mark + o))
        return pd.DataFrame(out, columns=["cuts", "mark"])

    offset = F.col("_i").cast("bigint") * block
    done = cut(long.join(states.filter(F.col("_i").isNotNull()), ["_row", "_i"]).select("_row", "_i", emit("_b", "_s", offset).alias("_e")))
    w = Window.partitionBy("_row").orderBy("_i")
    earlier = F.last(F.when(F.col("_e.mark") != -1, F.col("_e.mark")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cuts = done.select("_row", "_e.cuts", earlier.alias("_m")).select("_row", F.explode("cuts").alias("_c"), "_m")
    cuts = cuts.select("_row", F.when(F.col("_c") == -1, F.col("_m")).otherwise(F.col("_c")).alias("_c"))
    listed = cuts.groupBy("_row", F.floor(F.col("_c") / block).cast("int").alias("_i")).agg(F.array_sort(F.collect_list("_c")).alias("_cuts"))  # those of one block

    @F.pandas_udf("array<struct<no:bigint,start_pos:bigint,end_pos:bigint>>")
    def parts(blocks: pd.Series, cut_at: pd.Series, offset: pd.Series) -> pd.Series:
        """What a block sees of each sentence: its number among those that begin here (0 goes on from before), first and last character."""
        out = []
        for b, cs, o in zip(blocks, cut_at, offset, strict=True):
            at, seen = 0, []
            for no, c in enumerate([*(int(x) - o for x in (() if cs is None else cs)), len(b)]):
                piece = b[at:c]
                bare = piece.strip()
                if bare:
                    s = at + len(piece) - len(piece.lstrip())
                    seen.append({"no": no, "start_pos": s + o, "end_pos": s + len(bare) + o})
                at = max(at, c)
            out.append(seen)
        return pd.Series(out, dtype=object)

    before = F.coalesce(F.sum(F.coalesce(F.size("_cuts"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    there = long.join(listed, ["_row", "_i"], "left").withColumn("_n", before)  # counted before rows multiply or go
    seen = there.select("_keys", "_row", "_n", F.explode(parts("_b", "_cuts", offset)).alias("_p"))
    joined = seen.groupBy("_row", (F.col("_n") + F.col("_p.no")).alias("_no")).agg(F.first("_keys").alias("_keys"), F.min("_p.start_pos").alias("start_pos"), F.max("_p.end_pos").alias("end_pos"))
    return short.unionByName(joined.select(*names, "start_pos", "end_pos"))
