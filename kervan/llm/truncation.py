"""Texts that were cut before their end, and how often each source cuts.

Per source, lengths (in characters and in bytes) are fitted by maximum likelihood with a log-normal distribution that
is right-censored at a candidate limit; where the fit with a limit beats the one without, a value just below the limit
has a posterior of having been censored there. Its log odds (for other values those of being cut in transfer) are
added to what the ending says: the log of how much likelier this kind of ending is at a cut than at a natural end. The
kinds are weighed by the corpus itself: every text is cut once at a place that its hash draws, and read once up to one
of its own natural ends; how often cuts leave a mark is taken from the texts at the limits, by their posteriors.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kervan.llm.sentences import ABBREVIATIONS
from kervan.session import cut

#: Positions below a limit within which a cut may fall (the cut word, or what was added).
WINDOW = 24
#: Kinds of endings that complete a text: by definition they are no case, wherever they stand.
COMPLETE = ("stop", "fixed", "empty")
#: Kinds that depend on whether their tail ends sentences elsewhere.
SPLIT = ("trail", "list", "bare")
KINDS = ("added", "trail_open", "trail_final", "short", "number", "list_open", "list_final", "bare_open", "bare_final", "open", *COMPLETE)
#: Share of texts cut in transfer from which the fit starts.
TRANSFER = 0.02

_STOP = ".!?。।॥؟！？۔"
_QUOTES = "\"'”’»“›」』)）]"
_ADDED = re.compile(r"(?:�|<[a-zA-Z/!]?[^<>\n]{0,20}|&#?\w{0,6}|\[(?:devamı|continued|\.\.\.)\]?|\((?:devamı|continued)[^)]*\)?)\s*\Z")
_TRAIL = re.compile(r"\s*(?:…|\.{3,}|\[\s*(?:…|\.{3})\s*\])\s*\Z")
_SYMBOLS = re.compile(r"[\s\U0001f000-\U0001faff☀-➿️‍]+\Z")
_ITEM = re.compile(r"\s*(?:[-•*–▪◦]\s|\d{1,3}[.)]\s)")
_FIXED = re.compile(r"\s*(?:[—–]{1,2}\s*\S.{0,60}|[^\W\d_][^:.!?\n]{1,24}:\s*[^\s.!?]*\d[^\s]*)\s*\Z")
_WORDS = re.compile(r"[^\W_]+")
_LAST_WORD = re.compile(r"[^\W_]+\Z")
_DIGITS = re.compile(r"\d+")
#: Characters at the end of a text among which marks of a cut and closing symbols are looked for.
_FAR = 256
#: Letters before a full stop that may be those of an abbreviation.
_SHORTEST = max(map(len, ABBREVIATIONS)) + 2
_NO_BLANKS = re.compile(r"[฀-๿぀-ヿ㐀-鿿]")
_END = re.compile(r"[.!?。।؟！？…;]+[\"'”’»“)\]]*(?:\s|\Z|(?<=[。！？])|(?<=[。！？][”」]))|\n+|(?<=[฀-๿]) (?=[฀-๿])")


def _tail(text: str, end: int) -> str:
    """How text[:end] ends: its last two words, or its last four letters in scripts without blanks; digits are alike."""
    found = _WORDS.findall(text, max(0, end - 48), end)
    if not found:
        return ""
    if _NO_BLANKS.search(found[-1]):
        letters = "".join(c for c in text[max(0, end - 40) : end] if c.isalpha() or "ั" <= c <= "๎")
        return letters[-4:]
    return " ".join([w.lower() if w.isalpha() else _DIGITS.sub("0", w.lower()) for w in found[-2:]])


def _key(tail: str) -> int:
    return int.from_bytes(hashlib.blake2b(tail.encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True) if tail else 0


def tail_key(text: str) -> int:
    """64-bit key of how a text ends."""
    return _key(_tail(text, len(text)))


def ending(text: str) -> tuple[str, int]:
    """(kind of ending, key of its tail): stop, fixed, added, trail, short, number, list, bare, open or empty."""
    s = text.rstrip()
    if not s:
        return "empty", 0
    low = max(0, len(s) - _FAR)
    if _ADDED.search(s, low) and not s.endswith(")") or s.endswith("�"):
        return "added", 0
    m = _TRAIL.search(s, low)
    if m:
        return "trail", _key(_tail(s, m.start()))
    m = _SYMBOLS.search(s, low)
    if m and m.start() == low:  # symbols as far as one looks
        m = _SYMBOLS.search(s)
    bare = s[: m.start()] if m else s
    symbol = len(bare) < len(s)
    if not bare:
        return "stop", 0
    last = bare[bare.rfind("\n") + 1 :]
    if "\n" in bare and _FIXED.match(last) and not _ITEM.match(last):
        return "fixed", 0
    core = bare.rstrip(_QUOTES)
    closed = len(core) < len(bare)
    end = core[-1:] or bare[-1]
    if end in _STOP:
        if end == "." and not closed:
            word = _LAST_WORD.search(core, max(0, len(core) - 80), len(core) - 1)
            if word and not word.group().isdigit():
                w = word.group().lower()
                if w in ABBREVIATIONS or len(w) == 1:
                    return "short", tail_key(core)
            elif word:
                return "number", tail_key(core)
        return "stop", 0
    if bare.endswith(";") or bare.endswith("；"):
        return "stop", 0
    if _ITEM.match(last):
        return "list", tail_key(core)
    if symbol or "฀" <= end <= "๿":
        return "bare", tail_key(core)
    return "open", tail_key(core)


def _ends(text: str) -> list[tuple[int, int, bool]]:
    """(where the words before it end, where it ends, whether it may be that of an abbreviation only) of the ends of sentences and lines inside a text; that of the text itself doesn't count."""
    out, stop = [], len(text.rstrip())
    for m in _END.finditer(text):
        if m.end() >= stop:
            break
        a = m.start()
        word = _LAST_WORD.search(text, max(0, a - _SHORTEST), a) if text[a] == "." else None
        out.append((a, m.end(), bool(word) and (len(w := word.group()) == 1 or w.lower() in ABBREVIATIONS)))
    return out


def final_keys(text: str) -> list[int]:
    """Keys of the tails before sentence ends inside the text; the end of the text itself doesn't count."""
    return _final_keys(text, _ends(text))


def _final_keys(text: str, ends: list[tuple[int, int, bool]]) -> list[int]:
    return sorted({_key(t) for t in {_tail(text, a) for a, _, doubtful in ends if not doubtful}} - {0})


def rehearse(text: str, found: list[tuple[int, int, bool]]) -> tuple[tuple[str, int], tuple[str, int]]:
    """(ending at a drawn cut, ending at a drawn natural end) inside a text; ('', 0) where it has no room for one."""
    draw = int.from_bytes(hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=8).digest(), "little")
    room, ends = len(text.rstrip()) - 16, [b for a, b, doubtful in found if not doubtful or "\n" in text[a:b]]
    return ending(text[: 8 + draw % room]) if room > 0 else ("", 0), ending(text[: ends[draw % len(ends)]]) if ends else ("", 0)


# ---- lengths ----


def _survival(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.fromiter(map(math.erfc, z / math.sqrt(2)), float, len(z))


def fit_censored(n: np.ndarray, sy: np.ndarray, syy: np.ndarray, total: float, limit: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(mu, sigma) of log lengths, one fit per limit: n values seen whole with sums sy and syy of their logs and squared logs, the rest of total known to exceed limit."""
    c, censored = np.log(limit), total - n
    mu, sd = sy / np.maximum(n, 1), np.ones(len(n))
    for _ in range(rounds):
        z = (c - mu) / sd
        lam = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) / np.maximum(_survival(z), 1e-12)
        e1, e2 = mu + sd * lam, mu * mu + sd * sd + sd * (c + mu) * lam  # moments of a value known to exceed the limit
        mu = (sy + censored * e1) / total
        sd = np.maximum(np.sqrt(np.maximum((syy + censored * e2) / total - mu * mu, 1e-4)), 0.05)
    return mu, sd


def _clearest(x: np.ndarray, n: np.ndarray, unfinished: np.ndarray, total: float) -> tuple[float, int, dict[int, float]]:
    """(gain, limit, posterior of having been cut per length) of the clearest limit; gain 0 where there is none.

    x: distinct lengths in order, n of total texts each, of which so many are unfinished. Every length is a candidate.
    A limit's window holds what the fitted tail beyond it would have; the gain in likelihood must beat the cost of a
    parameter. Where more than one per cent is longer, only some texts meet the limit (those of one channel, say):
    then the unfinished texts alone must be more than the fit expects of all, and stand out from the windows beside.
    """
    y = np.log(x)
    cum, cum_u, sy, syy = (np.concatenate([[0], np.cumsum(v)]) for v in (n, unfinished, n * y, n * y * y))
    low = np.searchsorted(x, x - WINDOW, "right")
    i = np.flatnonzero((cum[1:] - cum[low] >= 4) & (x > 2 * WINDOW) & (cum[low] >= 10))
    if not i.size:
        return 0.0, 0, {}
    low, edge = low[i], x[i] - WINDOW
    some = total - cum[i + 1] > 0.01 * total
    k = np.where(some, cum_u[i + 1] - cum_u[low], cum[i + 1] - cum[low])
    mu, sd = fit_censored(cum[low], sy[low], syy[low], total, edge)
    expected = total * np.maximum(_survival((np.log(edge) - mu) / sd) - _survival((y[i] - mu) / sd), 1e-9)
    beside = np.maximum(cum_u[low] - cum_u[np.searchsorted(x, edge - WINDOW, "right")], cum_u[np.searchsorted(x, x[i] + WINDOW, "right")] - cum_u[i + 1])
    level = np.maximum((k + 2 * beside) / 3, 1e-9)
    apart = np.where(k > level, k * np.log(np.maximum(k, 1) / level) + 2 * beside * np.log(np.maximum(beside, 1) / level), 0.0)
    gain = np.where(k > expected, k * np.log(np.maximum(k, 1) / expected) - (k - expected), 0.0)
    gain = np.where(some, np.where(unfinished[i] > expected / WINDOW, np.minimum(gain, apart), 0.0), gain)
    j = int(np.argmax(gain))
    if gain[j] <= math.log(total) + 4:
        return 0.0, 0, {}
    plain = max(expected[j], beside[j] if some[j] else 0.0) / WINDOW
    span = slice(low[j], i[j] + 1)
    return float(gain[j]), int(x[i[j]]), {int(v): float(min(0.9999, max(0.0, 1 - plain / c))) for v, c in zip(x[span], n[span], strict=True) if c}


def find_limits(lengths: dict[str, np.ndarray], count: np.ndarray, unfinished: np.ndarray) -> list[tuple[str, int, dict[int, float]]]:
    """(unit, limit, posterior of having been cut per length) of every limit of one source, the clearest first.

    lengths: per unit the length of each group of count texts. The texts at a limit are taken out of the windows before the next
    is looked for, so that they don't give a shadow in the other unit, but stay known to exceed what lies below.
    """
    total, out = float(count.sum()), []
    left = np.ones(len(count), bool)
    while total >= 20:
        best = (0.0, "", 0, {})
        for unit, length in lengths.items():
            kept = left & (length > 0)
            x, at = np.unique(length[kept], return_inverse=True)
            gain, limit, share = _clearest(x.astype(float), *(np.bincount(at, v[kept], len(x)) for v in (count, unfinished)), total)
            if gain > best[0]:
                best = gain, unit, limit, share
        _, unit, limit, share = best
        if not unit:
            break
        out.append((unit, limit, share))
        left &= (lengths[unit] <= limit - WINDOW) | (lengths[unit] > limit)
    return out


def find_limit(length: np.ndarray, count: np.ndarray) -> tuple[int, dict[int, float]]:
    """The clearest limit of lengths in one unit; (0, {}) where no limit fits better."""
    return next((x[1:] for x in find_limits({"chars": length}, count, count)), (0, {}))


def fit_sources(lengths: DataFrame) -> DataFrame:
    """source, unit, limit, length, posterior: lengths of a source at which values were cut, with the posterior.

    lengths: source, n_chars, n_bytes, kind of ending. Every length is counted exactly, per source with a map-side
    combine; one task fits a source from one row per pair of lengths that occurs.
    """
    unfinished = F.count_if(~F.col("kind").isin("stop", "fixed")).alias("unfinished")
    hist = lengths.groupBy("source", "n_chars", "n_bytes").agg(F.count("*").alias("n"), unfinished)

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        limits = find_limits({"chars": f["n_chars"].to_numpy(), "bytes": f["n_bytes"].to_numpy()}, f["n"].to_numpy(), f["unfinished"].to_numpy())
        rows = [(f["source"].iloc[0], unit, limit, *kv) for unit, limit, share in limits for kv in share.items()]
        return pd.DataFrame(rows, columns=["source", "unit", "limit", "length", "posterior"])

    return hist.groupBy("source").applyInPandas(fit, "source string, unit string, limit long, length long, posterior double")


# ---- decision ----


def weigh(cuts: dict[str, float], tails_final: float, naturals: dict[str, float], seen: list[tuple[str, float, float]]) -> tuple[dict[str, float], float]:
    """(log odds of each kind of ending, share cut in transfer).

    cuts and naturals: how often drawn cuts and natural ends came out as each kind; tails_final: the share of drawn
    cuts whose tail ends sentences elsewhere. seen: kind, posterior of the length, and number of the stored texts;
    the texts at limits, by their posteriors, say how often a cut leaves a mark, which drawn cuts never do.
    """
    n_cut, n_natural = sum(cuts.values()) + 1, sum(naturals.values()) + 1
    at_limit = sum(p * n for k, p, n in seen if p and k not in COMPLETE) + 10
    trail, added = ((sum(p * n for k, p, n in seen if k.startswith(mark)) + 0.5) / at_limit for mark in ("trail", "added"))
    odds = {}
    for k in KINDS:
        at_cut = (1 - trail - added) * (cuts.get(k, 0) + 0.5) / n_cut
        if k.startswith("trail"):
            at_cut += trail * (tails_final if k == "trail_final" else 1 - tails_final)
        elif k == "added":
            at_cut += added
        odds[k] = math.log(at_cut / ((naturals.get(k, 0) + 0.5) / n_natural))
    share = TRANSFER
    rest = [(k, n) for k, p, n in seen if not p]
    for _ in range(30 if rest else 0):
        cut_ = sum(n / (1 + math.exp(-odds[k]) * (1 - share) / share) for k, n in rest if k not in COMPLETE)
        share = min(0.2, max(1e-4, cut_ / sum(n for _, n in rest)))
    return odds, share


def judge(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """key, source, kind, posterior, odds, is_cut, by_length: one row per text that isn't null.

    A text is cut if the log odds of its length and of its ending come out above 0; one whose ending completes a
    sentence, or is a signature, reference or blank, never is. by_length: whether its length changed the decision.
    Empty and blank texts aren't cut. A null source is a source of its own. Copies of a text that is judged cut are
    cut too. key identifies a row, repeated rows count once in the result; columns of any name don't matter.
    """

    @F.pandas_udf("struct<kind:string,tail:bigint,finals:array<bigint>,cut_kind:string,cut_tail:bigint,end_kind:string,end_tail:bigint>")
    def look(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            ends = _ends(t)
            at_cut, at_end = rehearse(t, ends)
            rows.append((*ending(t), _final_keys(t, ends), *at_cut, *at_end))
        return pd.DataFrame(rows, columns=["kind", "tail", "finals", "cut_kind", "cut_tail", "end_kind", "end_tail"])

    rows = df.select(F.col(key).alias("_key"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("_t")).filter(F.col("_t").isNotNull())
    seen = rows.select("_key", "source", F.length("_t").alias("n_chars"), F.octet_length("_t").alias("n_bytes"), F.md5("_t").alias("_copy"), look("_t").alias("_e"))
    seen = cut(seen.select("_key", "source", "n_chars", "n_bytes", "_copy", "_e.*"))
    finals = seen.select(F.explode("finals").alias("tail")).groupBy("tail").agg(F.count("*").alias("n_final")).filter(F.col("n_final") >= 2).select("tail", F.lit(True).alias("_final"))
    final = F.coalesce("_final", F.lit(False))
    split = F.when(F.col("kind").isin(*SPLIT), F.concat("kind", F.when(final, F.lit("_final")).otherwise(F.lit("_open")))).otherwise(F.col("kind"))
    drawn = seen.select(F.inline(F.array(F.struct(F.lit("cut").alias("what"), F.col("cut_kind").alias("kind"), F.col("cut_tail").alias("tail")), F.struct(F.lit("end").alias("what"), F.col("end_kind").alias("kind"), F.col("end_tail").alias("tail")))))
    drawn = drawn.filter(F.col("kind") != "").groupBy("what", "kind", "tail").agg(F.count("*").alias("n")).join(finals, "tail", "left")
    drawn = drawn.groupBy("what", split.alias("kind"), final.alias("final")).agg(F.sum("n").alias("n")).collect()  # kinds, twice four times at most
    fits = fit_sources(seen.filter(F.col("kind") != "empty").dropDuplicates(["source", "_copy"]))  # a text stored often is no limit
    post = cut(fits.groupBy("source", "unit", "length").agg(F.max("posterior").alias("posterior")))
    chars = post.filter(F.col("unit") == "chars").select("source", F.col("length").alias("n_chars"), F.col("posterior").alias("_pc"))
    octets = post.filter(F.col("unit") == "bytes").select("source", F.col("length").alias("n_bytes"), F.col("posterior").alias("_pb"))
    doubtful = seen.filter(F.col("kind").isin(*SPLIT)).select("tail").distinct()
    j = seen.select("_key", "source", "n_chars", "n_bytes", "_copy", "kind", "tail").join(finals.join(doubtful, "tail", "left_semi"), "tail", "left")
    j = j.join(chars, ["source", "n_chars"], "left").join(octets, ["source", "n_bytes"], "left")
    j = cut(j.select("_key", "source", "_copy", split.alias("kind"), F.greatest(F.coalesce("_pc", F.lit(0.0)), F.coalesce("_pb", F.lit(0.0))).alias("posterior")))
    counts = j.dropDuplicates(["source", "_copy"]).groupBy("kind", F.round("posterior", 2).alias("p")).agg(F.count("*").alias("n")).collect()  # kinds times a hundred at most

    def drawn_as(what: str) -> dict[str, float]:
        return {k: sum(r["n"] for r in drawn if (r["what"], r["kind"]) == (what, k)) for k in KINDS}

    cuts = drawn_as("cut")
    tails_final = (sum(r["n"] for r in drawn if r["what"] == "cut" and r["final"]) + 0.5) / (sum(cuts.values()) + 1)
    odds, share = weigh(cuts, tails_final, drawn_as("end"), [(r["kind"], r["p"], r["n"]) for r in counts])
    weight = F.element_at(F.create_map(*[F.lit(v) for kv in odds.items() for v in kv]), F.col("kind"))
    p = F.least(F.lit(0.9999), F.greatest(F.col("posterior"), F.lit(share)))
    able = ~F.col("kind").isin(*COMPLETE)
    j = j.withColumns({"odds": F.log(p / (1 - p)) + weight, "_ending": F.lit(math.log(share / (1 - share))) + weight})
    copies = j.groupBy("_copy").agg(F.max(F.when(able, F.col("odds"))).alias("_most"), F.max(F.when(able, F.col("_ending"))).alias("_without"))
    out = j.join(copies, "_copy").withColumn("is_cut", F.coalesce(F.col("_most") > 0, F.lit(False)))
    out = out.withColumn("by_length", F.col("is_cut") != F.coalesce(F.col("_without") > 0, F.lit(False)))
    return out.select(F.col("_key").alias(key), "source", "kind", "posterior", "odds", "is_cut", "by_length").dropDuplicates([key])


def report(judged: DataFrame) -> DataFrame:
    """source, n_texts, n_cut, share, n_by_length: how often each source cuts, and how many decisions the length made."""
    g = judged.groupBy("source").agg(F.count("*").alias("n_texts"), F.count_if("is_cut").alias("n_cut"), F.count_if("by_length").alias("n_by_length"))
    return g.withColumn("share", F.round(F.col("n_cut") / F.col("n_texts"), 6))
