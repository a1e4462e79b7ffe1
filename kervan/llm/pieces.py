"""Cutting oversized values into overlapping pieces at natural boundaries.

A value, or a file that fits no memory, is worked off in ranges: each range, read with a halo on both sides, gives the
boundaries inside it as offsets of the whole; the boundary tables of neighbouring ranges are stitched; the cutting
plan is made from these tables alone, pieces are numbered by a prefix sum and emitted by offset. No worker holds a
whole file; a value is split where it is read, and its ranges travel on their own.
Positions count code points (table values) or bytes (files).
"""

from __future__ import annotations

import re
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kervan.session import task_slots

LIMIT, OVERLAP = 1200, 100
#: Code points of a value, or bytes of a file, that one worker looks at; a boundary never spans more than HALO.
RANGE, HALO = 65_536, 64

# Ranks of boundaries; UNSAFE marks a position where no cut may fall (before a mark that belongs to its base).
PARAGRAPH, LINE, SENTENCE, WORD, UNSAFE = 4, 3, 2, 1, 0
_BOUNDARY = re.compile(
    r"(?P<p>[^\S\n]*\n[^\S\n]*\n\s*)|(?P<l>[^\S\n]*\n\s*)"
    r"|(?P<s>[.!?…؟।]+[\"'”»“’)\]]*[^\S\n]+(?![a-zçğıöşüäößа-яα-ω])|[。！？]+[」』”’]*)"
    r"|(?P<w>[^\S\n]+|[、，；])|(?P<x>[\u0300-\u036f\u200c\u200d\ufe00-\ufe0f]|(?<=\u200d).)"
)
_RANK = {"p": PARAGRAPH, "l": LINE, "s": SENTENCE, "w": WORD, "x": UNSAFE}
_PIECES = "array<struct<start:bigint,fresh:bigint,end:bigint>>"


def boundaries(text: str, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions where a piece may end, their ranks) with start < position <= stop; text is a range with its halo."""
    at, rank = [], []
    for m in _BOUNDARY.finditer(text):
        k = m.start() if m.lastgroup == "x" else m.end()
        if start < k <= stop:
            at.append(k)
            rank.append(_RANK[m.lastgroup])
    return np.asarray(at, np.int64), np.asarray(rank, np.int8)


def _hard(at: np.ndarray, rank: np.ndarray, low: int, high: int) -> int:
    """The last position up to high where a cut may fall though no boundary is there."""
    bad = set(at[rank == UNSAFE].tolist())
    k = high
    while k > low + 1 and k in bad:
        k -= 1
    return k if k > low + 1 or k not in bad else high


def anchor(at: np.ndarray, rank: np.ndarray, begin: int, stop: int, limit: int) -> int:
    """Where the pieces of a range that isn't the last one end: its best boundary within the last `limit` positions."""
    low = max(begin, stop - limit)
    ok = (at > low) & (rank > UNSAFE)
    return int(at[ok][rank[ok] == rank[ok].max()][-1]) if ok.any() else _hard(at, rank, low, stop)


def plan(begin: int, stop: int, at: np.ndarray, rank: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Pieces (start, fresh, end) that cover begin..stop: text[start:end] is a piece, text[start:fresh] repeats the one before.

    A piece ends at the last boundary of the highest rank in the second half of its room, else at the last boundary
    of any rank, else hard. The repeated part starts at a sentence if it can, else at a blank, else has `overlap`
    positions; the first piece of the whole text repeats nothing.
    """
    good, ranks = at[rank > UNSAFE], rank[rank > UNSAFE]

    def back(end: int) -> int:
        lo, hi = np.searchsorted(good, [end - overlap, end], "left")
        if hi > lo:
            s = ranks[lo:hi] >= SENTENCE
            return int(good[lo:hi][s][0]) if s.any() else int(good[lo])
        return _hard(at, rank, max(0, end - overlap), end - overlap) if end > overlap else 0

    out, fresh, start = [], begin, back(begin) if begin and overlap else begin
    while stop - start > limit:
        room = start + limit
        lo, hi = np.searchsorted(good, [max(fresh, start + limit // 2), room], "right")
        if hi > lo:
            end = int(good[lo:hi][ranks[lo:hi] == ranks[lo:hi].max()][-1])
        else:
            lo = np.searchsorted(good, fresh, "right")
            end = int(good[hi - 1]) if hi > lo else _hard(at, rank, fresh, room)
        out.append((start, fresh, end))
        start, fresh = (back(end) if overlap else end), end
    if stop > fresh:
        out.append((start, fresh, stop))
    return out


def _check(limit: int, overlap: int) -> None:
    if limit < 2 or not 0 <= overlap <= limit // 2:
        raise ValueError("limit must be 2 or more and overlap at most half of it")


def _stitched(tables: DataFrame, key: str, limit: int, overlap: int) -> DataFrame:
    """tables plus _pieces (of each range) and _before, the pieces of the ranges before it.

    tables: key, _i, _begin, _stop, _last, at, rank, more. A range needs the end of the boundary table of the range
    before it and nothing else; piece numbers are a prefix sum of counts.
    """

    @F.pandas_udf("struct<end:bigint,at:array<bigint>,rank:array<int>>")
    def ends(at: pd.Series, rank: pd.Series, begin: pd.Series, stop: pd.Series, last: pd.Series) -> pd.DataFrame:
        rows = []
        for a, r, b0, b1, z in zip(at, rank, begin, stop, last, strict=True):
            a, r = np.asarray(a, np.int64), np.asarray(r, np.int64)
            tail = a > b1 - limit - overlap - 1
            rows.append((b1 if z else anchor(a, r, b0, b1, limit), a[tail], r[tail]))
        return pd.DataFrame(rows, columns=["end", "at", "rank"])

    @F.pandas_udf(_PIECES)
    def pieces(at: pd.Series, rank: pd.Series, end: pd.Series, before: pd.DataFrame) -> pd.Series:
        out = []
        for a, r, e, b1, pa_, pr in zip(at, rank, end, before["end"], before["at"], before["rank"], strict=True):
            first = b1 is None or pd.isna(b1)
            a, r = (np.asarray(a, np.int64), np.asarray(r, np.int64)) if first else (np.concatenate([pa_, a]).astype(np.int64), np.concatenate([pr, r]).astype(np.int64))
            out.append([dict(start=x, fresh=y, end=z) for x, y, z in plan(0 if first else int(b1), int(e), a, r, limit, overlap)])
        return pd.Series(out, dtype=object)

    w = Window.partitionBy(key).orderBy("_i")
    t = tables.withColumn("_e", ends("at", "rank", "_begin", "_stop", "_last"))
    t = t.withColumn("_p", F.lag("_e").over(w)).withColumn("_pieces", pieces("at", "rank", "_e.end", F.struct("_p.end", "_p.at", "_p.rank")))
    return t.withColumn("_before", F.coalesce(F.sum(F.size("_pieces")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("at", "rank", "_e", "_p")


def ranges_of(text: Column, size: int, before: int, after: int) -> Column:
    """Array of (part, low): a value's ranges of `size` code points, each with the end of the range before it and the beginning of the next; low is the position of a part's first code point. One pass over the value."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))

    def one(x: Column, i: Column) -> Column:
        head = F.coalesce(F.get(parts, i - 1), F.lit(""))
        head = F.substring(head, F.lit(1) + F.greatest(F.length(head) - before, F.lit(0)), F.lit(before))
        next_ = F.substring(F.coalesce(F.get(parts, i + 1), F.lit("")), 1, after)
        return F.struct(F.concat(head, x, next_).alias("part"), (i.cast("bigint") * size - F.length(head)).alias("low"))

    return F.transform(parts, one)


def cut_values(df: DataFrame, text: str, keys: list[str], limit: int = LIMIT, overlap: int = OVERLAP, span: int = RANGE) -> DataFrame:
    """keys + piece_no (from 0), start_pos, fresh_pos, end_pos, piece, of every value longer than limit.

    Null, empty and short values give no rows. A repeated row gives its pieces again, null keys are keys like others;
    columns besides keys and text don't travel, whatever they are called. A piece has at most `limit` code points;
    joined from fresh_pos on, the pieces are the value. Every value is planned by ranges of `span`, in most values one:
    the pieces of a range end at its best boundary near its end, so that ranges are planned on different workers; each
    travels with the end of the range before it, and no row holds more than a range. A run of blanks above HALO at
    a range's end counts as far as the halo shows it.
    """
    _check(limit, overlap)
    before = limit + overlap + HALO
    long = df.select(F.struct(*keys).alias("_keys"), F.col(text).alias("_t")).filter(F.length("_t") > limit).withColumn("_row", F.monotonically_increasing_id())

    @F.pandas_udf("struct<at:array<bigint>,rank:array<int>>")
    def scan(part: pd.Series, low: pd.Series, begin: pd.Series, stop: pd.Series) -> pd.DataFrame:
        rows = []
        for p, o, b, e in zip(part, low, begin, stop, strict=True):
            skip = max(0, b - o - HALO)
            at, rank = boundaries(p[skip:], b - o - skip, e - o - skip)
            rows.append((at + o + skip, rank))
        return pd.DataFrame(rows, columns=["at", "rank"])

    @F.pandas_udf("array<string>")
    def emit(part: pd.Series, low: pd.Series, pieces: pd.Series) -> pd.Series:
        return pd.Series([[t[p["start"] - o : p["end"] - o] for p in ps] for t, o, ps in zip(part, low, pieces, strict=True)], dtype=object)

    r = long.select("_keys", "_row", F.length("_t").cast("bigint").alias("_n"), F.posexplode(ranges_of(F.col("_t"), span, before, HALO)).alias("_i", "_x"))
    r = r.select("_keys", "_row", "_i", F.col("_x.part").alias("_part"), F.col("_x.low").alias("_low"), (F.col("_i").cast("bigint") * span).alias("_begin"), F.least((F.col("_i").cast("bigint") + 1) * span, F.col("_n")).alias("_stop"), "_n")
    r = r.withColumns({"_last": F.col("_stop") == F.col("_n"), "_b": scan("_part", "_low", "_begin", "_stop")}).withColumns({"at": F.col("_b.at"), "rank": F.col("_b.rank")})
    done = _stitched(r.drop("_b", "_n"), "_row", limit, overlap).withColumn("_texts", emit("_part", "_low", "_pieces"))
    out = done.select("_keys", "_before", F.posexplode(F.arrays_zip(F.col("_pieces").alias("p"), F.col("_texts").alias("t"))).alias("_k", "_x"))
    return out.select(
        *[F.col("_keys")[k].alias(k) for k in keys], (F.col("_before") + F.col("_k")).cast("int").alias("piece_no"),
        F.col("_x.p.start").alias("start_pos"), F.col("_x.p.fresh").alias("fresh_pos"), F.col("_x.p.end").alias("end_pos"), F.col("_x.t").alias("piece"),
    )


def _open(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(name), system.get_file_info(name).size


def _bytes(path: str, low: int, high: int) -> bytes:
    f, size = _open(path)
    with f:
        f.seek(max(0, low))
        return f.read(min(high, size) - max(0, low))


def _byte_table(data: bytes, low: int, begin: int, stop: int) -> tuple[list[int], list[int]]:
    """Boundaries as byte offsets of the file; bytes that continue a character are UNSAFE."""
    lead = next((i for i in range(min(4, len(data))) if data[i] & 0xC0 != 0x80), 0)
    text = data[lead:].decode("utf-8", "surrogateescape")
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = np.select([(code < 0x80) | (code >= 0xD800) & (code < 0xE000), code < 0x800, code < 0x10000], [1, 2, 3], 4)  # bytes that are no text count one
    offset = np.concatenate([[0], np.cumsum(width)]) + low + lead
    at, rank = boundaries(text, 0, len(text))
    at = offset[at]
    raw = np.frombuffer(data, np.uint8)
    inner = np.flatnonzero((raw & 0xC0) == 0x80) + low
    at, rank = np.concatenate([at, inner]), np.concatenate([rank, np.zeros(len(inner), np.int8)])
    order = np.argsort(at, kind="stable")
    at, rank = at[order], rank[order]
    keep = (at > begin) & (at <= stop)
    return at[keep].tolist(), rank[keep].tolist()


def cut_files(spark: SparkSession, paths: list[str], limit: int = LIMIT, overlap: int = OVERLAP, span: int = RANGE) -> DataFrame:
    """path, piece_no, start_pos, fresh_pos, end_pos, piece of UTF-8 files, or all files of folders, on storage all workers reach; sizes are bytes.

    Ranges are read with a halo and planned like those of values; each is read once more for its pieces, which are
    emitted by offset. The list of files is a scan that reads no contents. Empty files give no row.
    """
    _check(limit, overlap)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", F.col("length").alias("size")).filter(F.col("size") > 0)
    r = files.select("path", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / span).cast("int"))).alias("_i"))
    r = r.repartition(task_slots(spark), "path", "_i").withColumn("_begin", F.col("_i").cast("bigint") * span)
    r = r.withColumns({"_stop": F.least(F.col("_begin") + span, F.col("size"))}).withColumn("_last", F.col("_stop") == F.col("size"))

    @F.pandas_udf("struct<at:array<bigint>,rank:array<int>>")
    def scan(path: pd.Series, begin: pd.Series, stop: pd.Series) -> pd.DataFrame:
        rows = []
        for p, b, e in zip(path, begin, stop, strict=True):
            low = max(0, b - HALO * 4)
            rows.append(_byte_table(_bytes(p, low, e + HALO * 4), low, b, e))
        return pd.DataFrame(rows, columns=["at", "rank"])

    @F.pandas_udf("array<string>")
    def emit(path: pd.Series, pieces: pd.Series) -> pd.Series:
        out = []
        for p, ps in zip(path, pieces, strict=True):
            low = ps[0]["start"] if len(ps) else 0
            data = _bytes(p, low, ps[-1]["end"]) if len(ps) else b""
            out.append([data[x["start"] - low : x["end"] - low].decode("utf-8", "replace") for x in ps])
        return pd.Series(out, dtype=object)

    r = r.withColumn("_b", scan("path", "_begin", "_stop")).select("path", "_i", "_begin", "_stop", "_last", "_b.at", "_b.rank")
    done = _stitched(r, "path", limit, overlap)
    done = done.repartition(task_slots(spark), "path", "_i").withColumn("_texts", emit("path", "_pieces"))
    out = done.select("path", "_before", F.posexplode(F.arrays_zip(F.col("_pieces").alias("p"), F.col("_texts").alias("t"))).alias("_k", "_x"))
    return out.select("path", (F.col("_before") + F.col("_k")).cast("int").alias("piece_no"), F.col("_x.p.start").alias("start_pos"), F.col("_x.p.fresh").alias("fresh_pos"), F.col("_x.p.end").alias("end_pos"), F.col("_x.t").alias("piece"))
