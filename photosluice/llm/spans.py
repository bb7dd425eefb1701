"""Long spans that stand verbatim in more than one text, by level-wise doubling.

Windows of a quarter of the wanted length are chosen by content (every stretch of the wanted
length holds at least one, the same in every text). Those that occur in one text only are dropped;
the others are extended to twice that length, both ways, and again only repeated ones survive.
Where survivors leave room for it, windows of twice the wanted length are chosen by content, and
those repeated are extended to twice that length again, until no candidates survive: whatever
lies inside one is shared without more ado, and one text alone stands for its inner windows. Around
all other survivors every window of the wanted length is compared, so the result is exact, and
a passage copied often costs its length once and a few rows a copy. Each
level touches only what the level before left, and no pairs of texts are ever formed.

Windows of the wanted length and more are compared by two independent hashes of their
characters, 128 bits together.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photosluice.core.storage import settle

MIN_CHARS = 160
CHARS_AT_ONCE = 1_000_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= _B
    x ^= x >> np.uint64(29)
    return x


def window_hashes(codes: np.ndarray, base: int, doublings: int, _A: np.uint64 = _A) -> list[np.ndarray]:
    """Hashes of all windows of ``base * 2**i`` characters, i = 0..doublings, by their start."""
    n = max(len(codes) - base + 1, 0)
    h = codes[:n].astype(np.uint64)
    for i in range(1, base):
        h *= _A
        h += codes[i : i + n]
    h = _mix(h * _A + np.uint64(base)) if n else h
    out, size = [h], base
    for _ in range(doublings):
        n = max(len(h) - size, 0)
        h = _mix(h[:n] * _A + h[size : size + n]) if n else np.zeros(0, np.uint64)
        out.append(h)
        size *= 2
    return out


def _sliding(x: np.ndarray, w: int, op, fill) -> np.ndarray:
    """``op`` over every window of ``w`` values of ``x``."""
    n = len(x)
    blocks = -(-n // w)
    pad = np.full(blocks * w, fill, x.dtype)
    pad[:n] = x
    grid = pad.reshape(blocks, w)
    ahead = op.accumulate(grid, axis=1).ravel()
    back = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    return op(back[:m], ahead[w - 1 : w - 1 + m])


def chosen_windows(h: np.ndarray, w: int) -> np.ndarray:
    """Starts whose hash is the least of some ``w`` neighbouring ones (winnowing)."""
    if len(h) < w:
        return np.flatnonzero(h == h.min()) if len(h) else np.zeros(0, np.int64)
    low = _sliding(h, w, np.minimum, np.uint64(2**64 - 1))
    # the largest of the minima of all windows that hold a start
    pad = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    return np.flatnonzero(_sliding(pad, w, np.maximum, np.uint64(0)) == h)


def _pieces(texts: list[str]):
    """Runs of texts of about ``CHARS_AT_ONCE`` characters: (first, code points, starts)."""
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) < CHARS_AT_ONCE):
            total += len(texts[j]) + 1
            j += 1
        codes = np.frombuffer("\n".join(texts[i:j]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.fromiter((len(t) for t in texts[i:j]), np.int64, j - i)
        yield i, codes, np.r_[0, np.cumsum(size + 1)[:-1]], size
        i = j


def _anchors(min_chars: int):
    """Map of (key, text) to chosen windows of a quarter with the hashes of both extensions."""
    quarter, half = min_chars // 4, min_chars // 2
    base, steps = _base(min_chars)
    reach = min_chars - quarter + 1

    def find(batches):
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            _, first = np.unique(keys, return_index=True)  # copies within a batch count once
            first.sort()
            keys, texts = keys[first], b.column(1).take(pa.array(first)).to_pylist()
            for i, codes, starts, size in _pieces(texts):
                h = window_hashes(codes, base, steps + 1)
                short, long = h[steps], h[steps + 1]
                at = chosen_windows(short, reach)
                text = np.searchsorted(starts, at, side="right") - 1
                p = at - starts[text]
                ok = p + quarter <= size[text]
                at, text, p = at[ok], text[ok], p[ok]
                left, right = p >= quarter, p + half <= size[text]
                hl = np.where(left, long[np.maximum(at - quarter, 0)], 0).astype(np.uint64)
                hr = np.where(right, long[np.minimum(at, len(long) - 1)], 0).astype(np.uint64) if len(long) else hl
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[i + text]),
                        pa.array(p.astype(np.int32)),
                        pa.array(short[at].view(np.int64)),
                        pa.array(hl.view(np.int64), mask=~left),
                        pa.array(hr.view(np.int64), mask=~right),
                    ],
                    names=["k", "p", "h", "hl", "hr"],
                )

    return find, "k long, p int, h long, hl long, hr long"


def _base(min_chars: int) -> tuple[int, int]:
    """Length of the shortest windows hashed, and the doublings from it to a quarter of ``min_chars``."""
    quarter = min_chars // 4
    base = next(b for b in (5, 4, 3, 2, 1) if quarter % b == 0 and (quarter // b) & (quarter // b - 1) == 0)
    return base, (quarter // base).bit_length() - 1


def _merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges ``low`` to ``high`` (exclusive) joined where they meet."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order]) if len(order) else high
    new = np.r_[True, low[1:] > high[:-1]] if len(low) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    return low[begin], high[np.r_[begin[1:], len(low)] - 1] if len(begin) else high


def _ranges(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, low, high) of a column of lists of ranges."""
    lists = batch.column(column)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    return row, *(flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))


_RANGES = "array<struct<low:int,high:int>>"


def _zones(min_chars: int):
    """Map of (key, length, starts of surviving halves) to the ranges in which windows of the full length may start."""

    def find(batches):
        for b in batches:
            n = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            lists = b.column(2)
            row = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy(zero_copy_only=False))
            s = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            low, high = np.maximum(s - min_chars // 2, 0), np.minimum(s, n[row] - min_chars) + 1
            ok = high > low
            row, low, high = row[ok], low[ok], high[ok]
            wide = int(n.max()) + 2 if len(n) else 1  # keeps the ranges of different rows apart
            low, high = _merged(row * wide + low, row * wide + high)
            yield _ranged(b.column(0), len(n), low // wide, low % wide, high % wide)

    return find, f"k long, zones {_RANGES}"


def _ranged(keys: pa.Array, n: int, row: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    cuts = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
    ranges = pa.StructArray.from_arrays([pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names=["low", "high"])
    return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(cuts, ranges)], names=["k", "zones"])


def _windows(min_chars: int, doublings: int):
    """Map of (key, text, zones, covered, lead) to windows of ``min_chars * 2**doublings`` characters with two hashes.

    Without ``doublings`` all that start in the zones and lie in no covered range, and all in a lead
    range, which are ``sure``; else those that lie in what the zones' windows span, and of these some
    chosen by content.
    """
    base, steps = _base(min_chars)
    size = min_chars << doublings

    def find(batches):
        for b in batches:
            keys, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            zone, inner, lead = (_ranges(b, c) for c in ("zones", "covered", "lead"))
            for i, codes, starts, length in _pieces(texts):
                h = window_hashes(codes, base, steps + 2 + doublings)
                g = window_hashes(codes, base, steps + 2 + doublings, _C)[-1]

                def inside(ranges, shift):
                    row, low, high = ranges
                    here = (row >= i) & (row < i + len(length)) & (high + shift > low)
                    at, change = starts[row[here] - i], np.zeros(len(codes) + 2, np.int64)
                    np.add.at(change, at + low[here], 1)
                    np.add.at(change, at + high[here] + shift, -1)
                    return np.cumsum(change)[: len(h[-1])] > 0

                take = inside(zone, min_chars - size)  # the last window ends where the zone's last one does
                sure = np.zeros(len(take), bool)
                if not doublings and len(inner[0]):
                    sure = inside(lead, 1 - min_chars)
                    take = sure | (take & ~inside(inner, 1 - min_chars))
                at = np.flatnonzero(take)
                if doublings:
                    at = np.intersect1d(at, chosen_windows(h[steps][: len(h[-1])], size // 4), assume_unique=True)
                text = np.searchsorted(starts, at, side="right") - 1
                for c in range(0, len(at), 500_000):
                    t = slice(c, c + 500_000)
                    p = at[t] - starts[text[t]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[i + text[t]]), pa.array(p.astype(np.int32)), pa.array(h[-1][at[t]].view(np.int64)), pa.array(g[at[t]].view(np.int64)), pa.array(sure[at[t]])],
                        names=["k", "p", "h", "g", "sure"],
                    )

    return find, "k long, p int, h long, g long, sure boolean"


def _repeated(windows: DataFrame, kinds: DataFrame | None, *by: str, more: tuple = (), sure: str = "false") -> DataFrame:
    """Hashes found in more than one document; ``kinds`` is given if some document has several texts."""
    first, last = F.col("k"), F.col("k")
    if kinds is not None:
        windows, first, last = windows.join(kinds.select("k", "rep", "last"), "k"), F.col("rep"), F.col("last")
    found = windows.groupBy(*by).agg(F.min(first).alias("lo"), F.max(last).alias("hi"), F.max(F.expr(sure)).alias("known"), *more)
    return found.where("lo <> hi or known").drop("lo", "hi", "known")


def _long_windows(text: DataFrame, marked: DataFrame, twins: DataFrame | None, min_chars: int) -> DataFrame | None:
    """(``k``, ``s``, ``e``, ``lead``): repeated stretches of twice ``min_chars`` and more, doubled until none survive.

    Of equal stretches one leads.
    """
    doublings, found = 1, []
    room = lambda size: F.filter("zones", lambda z: z["high"] - z["low"] > size - min_chars)
    zones = marked.select("k", "doc_id", room(2 * min_chars).alias("zones")).where(F.size("zones") > 0)
    live = settle(text.join(zones, ["k", "doc_id"]).select("k", "text", "n", "zones", F.array().cast(_RANGES).alias("covered"), F.array().cast(_RANGES).alias("lead")), "long-texts")
    while live.limit(1).count():
        size = min_chars << doublings
        find, schema = _windows(min_chars, doublings)
        windows = settle(live.select("k", "text", "zones", "covered", "lead").mapInArrow(find, schema), "long-windows")
        same = windows.join(_repeated(windows, twins, "h", "g", more=(F.min(F.struct("k", "p")).alias("one"),)), ["h", "g"])
        lead = (F.col("k") == F.col("one.k")) & (F.col("p") == F.col("one.p"))
        kept = settle(same.select("k", F.col("p").alias("s"), (F.col("p") + size).alias("e"), lead.alias("lead")), "long-kept")
        found.append(kept)
        # the next level lies around what survived
        around = kept.groupBy("k").agg(F.collect_list(F.struct(F.col("s").alias("low"), F.col("e").alias("high"))).alias("near"))
        near = F.transform("near", lambda x: F.struct(F.greatest(F.lit(0), x["low"] - size).alias("low"), (F.least(F.col("n"), x["high"] + size) - min_chars + 1).cast("int").alias("high")))
        live = live.join(around, "k").withColumn("zones", near).withColumn("zones", room(2 * size)).where(F.size("zones") > 0)
        live, doublings = settle(live.select("k", "text", "n", "zones", "covered", "lead"), "long-texts"), doublings + 1
    return reduce(DataFrame.unionByName, found) if found else None


def shared_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(``doc_id``, ``span_start``, ``span_chars``): maximal runs of shared characters, in code points.

    A character is shared if it lies in a stretch of at least ``min_chars`` characters that stands
    verbatim in another document too. Whole copies of a text are compared once and shared whole.
    A document delivered twice, be it in two versions, is no other document. Null, blank and
    shorter texts have no spans; documents without an id are left out; an empty table gives no
    rows; other columns are ignored. ``min_chars`` must be a multiple of 4 whose quarter is 1..5
    times a power of two.
    """
    if min_chars % 4:
        raise ValueError("min_chars must be a multiple of 4")
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(
        F.col("doc_id").isNotNull() & (F.length("text") >= min_chars)
    )
    text = text.select("doc_id", "text", F.xxhash64("text", F.length("text")).alias("k"))
    owners = settle(text.select("k", "doc_id", F.length("text").alias("n")).distinct(), "owners")
    kinds = owners.groupBy("k").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.max("n").alias("n"))
    twins = kinds if owners.groupBy("doc_id").count().where("count > 1").limit(1).count() else None
    find, schema = _anchors(min_chars)
    anchors = settle(text.select("k", "text").mapInArrow(find, schema), "anchors")
    level = anchors.join(_repeated(anchors.select("k", "h"), twins, "h"), "h", "left_semi")
    quarter = min_chars // 4
    twice = level.select("k", F.explode(F.array(F.struct((F.col("p") - quarter).alias("s"), F.col("hl").alias("h")), F.struct(F.col("p").alias("s"), F.col("hr").alias("h")))).alias("x"))
    twice = settle(twice.where("x.h is not null").select("k", "x.s", "x.h").distinct(), "halves")
    halves = twice.join(_repeated(twice, twins, "h"), "h", "left_semi").groupBy("k").agg(F.collect_set("s").alias("starts"))
    find, schema = _zones(min_chars)
    marked = halves.join(kinds, "k").select("k", F.col("n").cast("int").alias("n"), "starts").mapInArrow(find, schema)
    # of copies one is read
    marked = settle(marked.where(F.size("zones") > 0).join(kinds.select("k", F.col("rep").alias("doc_id")), "k"), "zones")
    one = text.select("k", "doc_id", "text", F.length("text").alias("n"))
    sure = _long_windows(one, marked, twins, min_chars)
    none = F.array().cast(_RANGES)
    rest = marked.withColumns({"covered": none, "lead": none})
    if sure is not None:
        of = lambda test: F.coalesce(F.collect_list(F.when(test, F.struct(F.col("s").alias("low"), F.col("e").alias("high")))), none)
        inner = sure.groupBy("k").agg(of(F.lit(True)).alias("covered"), of(F.col("lead")).alias("lead"))
        rest = marked.join(inner, "k", "left").withColumns({c: F.coalesce(c, none) for c in ("covered", "lead")})
    find, schema = _windows(min_chars, 0)
    windows = one.join(rest, ["k", "doc_id"]).select("k", "text", "zones", "covered", "lead").mapInArrow(find, schema)
    windows = settle(windows, "windows").distinct()
    windows = windows.join(_repeated(windows, twins, "h", "g", sure="sure"), ["h", "g"], "left_semi")
    every = windows.select("k", F.col("p").alias("s"), (F.col("p") + min_chars).alias("e"))
    runs = _runs(every if sure is None else every.unionByName(sure.drop("lead")))
    several = kinds.where("rep <> last")
    found = runs.join(several, "k", "left_anti").select("k", F.col("s").cast("long").alias("span_start"), (F.col("e") - F.col("s")).cast("long").alias("span_chars"))
    whole = several.select("k", F.lit(0).cast("long").alias("span_start"), F.col("n").cast("long").alias("span_chars"))
    return owners.select("k", "doc_id").join(found.unionByName(whole), "k").select("doc_id", "span_start", "span_chars")


def _runs(ranges: DataFrame) -> DataFrame:
    """(``k``, ``s``, ``e``): ranges joined where they meet."""
    w = Window.partitionBy("k").orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = ranges.withColumn("new", F.when(F.col("s") <= before, 0).otherwise(1))
    return new.withColumn("run", F.sum("new").over(w)).groupBy("k", "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("run")


def shared_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(``doc_id``, ``n_chars``, ``shared_chars``, ``shared_part``) of every document, null texts counting no characters."""
    every = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.coalesce(F.length(text_col), F.lit(0))).cast("long").alias("n_chars"))
    spans = shared_spans(docs, id_col, text_col, min_chars).groupBy("doc_id").agg(F.sum("span_chars").alias("shared_chars"))
    shared = F.coalesce("shared_chars", F.lit(0)).alias("shared_chars")
    part = F.when(F.col("n_chars") > 0, F.coalesce("shared_chars", F.lit(0)) / F.col("n_chars")).otherwise(0.0)
    return every.join(spans, "doc_id", "left").select("doc_id", "n_chars", shared, F.round(part, 6).alias("shared_part"))
