"""Exact substring deduplication: remove every byte inside a string of LENGTH bytes that also starts elsewhere.

Only suffixes that can have a partner are sorted. Each window of LENGTH bytes has an anchor: of the ANCHOR-byte
strings in it the one with the least hash, the leftmost of equals. Equal windows have equal anchors at equal places,
and consecutive windows share theirs, so that a text is a few runs of windows, each with its anchor, the anchor's
offsets and the bytes that the run covers (a segment).

1. Anchors that occur once in the corpus drop out: their windows have no partner.
2. Runs with equal anchors, offsets and segments (a 64-bit hash each of anchor and segment) are duplicates as a whole.
3. Anchors with several distinct segments need a look inside. One copy of each segment goes to a task by anchor, and
   the suffixes that start its windows are sorted there: prefix polynomial hashes give the hash of any substring, a
   binary search over them the longest common extension of two suffixes, and so the order of two suffixes in
   logarithmic time; a mergesort by ranks works on all runs at once. Neighbours with a common extension of LENGTH are
   duplicates once their bytes have been compared.
4. An anchor with more than HOT distinct segments (a passage with thousands of different surroundings) would be one
   task's work: its windows are counted by two 64-bit hashes over all tasks instead, which is exact as well.

The findings are joined back to the texts, which are cut. Nulls and edge cases: a null text is empty; texts shorter
than LENGTH lose nothing; equal texts, repeated rows among them, lose everything from LENGTH bytes on; a
text of any length is read whole, its runs counted where they are; an empty table
gives an empty result; other columns are ignored by report() and kept by deduplicated(), where a character that is
cut in two goes as a whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelframe.llm.arena import Prefix, chunks, mix
from levelframe.llm.common import BitFilter, saved, written

LENGTH = 200
ANCHOR = 40
#: Anchor places in a window.
PLACES = LENGTH - ANCHOR + 1
#: The segments' hashes use another base than the anchors'.
SEGMENT_BASE = 0xD6E8FEB86659FD93
#: Longer texts are cut into pieces that overlap, so that a place fits the bits beside its hash.
PIECE, PLACE_BITS = 4 << 20, 24
HOT = 4096
#: Bytes of segments that are sorted at once.
SORTED_BYTES = 2 << 20


def runs(b: np.ndarray, offsets: np.ndarray):
    """(text, first window, least anchor offset, windows, anchor hash, segment hash) of every run of windows."""
    n = len(b)
    empty = np.zeros(0, np.int64)
    if n < LENGTH:
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    prefix = Prefix(b)
    at = np.arange(n - ANCHOR + 1)
    hashes = mix(prefix.of(at, at + ANCHOR))
    low = np.uint64((1 << PLACE_BITS) - 1)
    keys = (hashes & ~low) | at.astype(np.uint64)
    blocks = -(-len(keys) // PLACES)
    padded = np.full(blocks * PLACES, 0xFFFFFFFFFFFFFFFF, np.uint64)
    padded[: len(keys)] = keys
    padded = padded.reshape(blocks, PLACES)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - LENGTH + 1
    anchor = (np.minimum(behind[:windows], ahead[PLACES - 1 : PLACES - 1 + windows]) & low).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:windows]
    fits = np.flatnonzero(np.arange(windows) + LENGTH <= offsets[text + 1])
    if not len(fits):
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    own = anchor[fits]
    cut = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (fits[1:] != fits[:-1] + 1))))
    first, last = fits[cut], fits[np.append(cut[1:], len(fits)) - 1]
    place = own[cut]
    segment = mix(Prefix(b, SEGMENT_BASE).of(first, last + LENGTH))
    return text[first], first - offsets[text[first]], place - last, last - first + 1, hashes[place], segment


def packed(first: np.ndarray, offset: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (first << 16) | (offset << 8) | count


def unpacked(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pos >> 16, (pos >> 8) & 255, pos & 255


RUN = "h long, g long, x long, c long, pos long"


def _run_rows(batches):
    for batch in batches:
        x, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("x", "c"))
        for lo, hi, b, offsets in chunks(batch.column("text")):
            for start in range(0, max(len(b), 1), PIECE) if hi == lo + 1 else (0,):
                part = b[start : start + PIECE + LENGTH - 1] if hi == lo + 1 else b
                text, first, offset, count, h, g = runs(part, np.array([0, len(part)]) if hi == lo + 1 else offsets)
                if len(text):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.astype(np.int64)), pa.array(g.astype(np.int64)), pa.array(x[lo + text].astype(np.int64)), pa.array(c[lo + text].astype(np.int64)), pa.array(packed(first + start, offset, count))],
                        ["h", "g", "x", "c", "pos"],
                    )


SEGMENT = "h long, g long, shape int, seg binary"


def _segments(batches):
    """The bytes of the segments that are asked for: asked is a list of (h, g, shape, first)."""
    for batch in batches:
        h, g, shape, seg = [], [], [], []
        for text, asked in zip(batch.column("text"), batch.column("asked"), strict=True):
            b = memoryview(text.as_buffer())
            for r in asked.as_py():
                h.append(r["h"])
                g.append(r["g"])
                shape.append(r["shape"])
                seg.append(bytes(b[r["first"] : r["first"] + (r["shape"] & 255) + LENGTH - 1]))
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(g, pa.int64()), pa.array(shape, pa.int32()), pa.array(seg, pa.binary())], ["h", "g", "shape", "seg"])


class Suffixes:
    """Suffixes of an array of bytes, compared by their first LENGTH bytes."""

    def __init__(self, b: np.ndarray):
        self.b, self.prefix = b, Prefix(b)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at i and j have in common, at most LENGTH: binary search over prefix hashes."""
        n = np.zeros(len(i), np.int64)
        for k in reversed(range(LENGTH.bit_length())):
            step = n + (1 << k)
            ok = np.flatnonzero(step <= LENGTH)
            p, q, m = i[ok] + n[ok], j[ok] + n[ok], 1 << k
            same = self.prefix.of(p, p + m) == self.prefix.of(q, q + m)
            n[ok[same]] = step[ok[same]]
        return n

    def before(self, i: np.ndarray, j: np.ndarray, or_equal: bool) -> np.ndarray:
        n = self.extension(i, j)
        whole = n >= LENGTH
        at = np.where(whole, 0, n)
        return np.where(whole, or_equal, self.b[i + at] < self.b[j + at])

    def sorted(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """at, with every group (equal neighbours in group) sorted: runs of 1, 2, 4 .. merge by each one's rank in
        the other."""
        at = at.copy()
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        start = np.repeat(first, np.diff(np.append(first, len(at))))
        end = np.repeat(np.append(first[1:], len(at)), np.diff(np.append(first, len(at))))
        width = 1
        while True:
            live = np.flatnonzero(end - start > width)
            if not len(live):
                return at
            place = live - start[live]
            run = place // width
            left = run % 2 == 0
            mate = start[live] + (run + np.where(left, 1, -1)) * width  # start of the other run
            stop = np.minimum(mate + width, end[live])
            lo, hi = np.minimum(mate, end[live]), np.maximum(stop, np.minimum(mate, end[live]))
            base = lo.copy()
            while len(open_ := np.flatnonzero(lo < hi)):
                mid = (lo[open_] + hi[open_]) // 2
                # a left one goes before equals in the right run, a right one after equals in the left run
                less = np.empty(len(open_), bool)
                own = left[open_]
                for side in (True, False):
                    k = np.flatnonzero(own == side)
                    less[k] = self.before(at[mid[k]], at[live[open_[k]]], not side)
                lo[open_] = np.where(less, mid + 1, lo[open_])
                hi[open_] = np.where(less, hi[open_], mid)
            pair = start[live] + (run // 2) * 2 * width
            target = pair + (place - run * width) + (lo - base)
            moved = at[live]
            at[target] = moved
            width *= 2


def repeated_windows(segments: list[bytes], anchors: np.ndarray, offset: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For segments with equal anchors where equal: (segment, least offset, greatest offset) rows of repeated windows."""
    lengths = np.array([len(s) for s in segments])
    base = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    suffixes = Suffixes(np.frombuffer(b"".join(segments), np.uint8))
    seg = np.repeat(np.arange(len(segments)), count)
    k = np.arange(len(seg)) - np.repeat(np.concatenate(([0], np.cumsum(count)))[:-1], count)
    a = offset[seg] + count[seg] - 1 - k  # the anchor's offset in the window
    at = base[seg] + k
    order = np.lexsort((a, anchors[seg]))
    seg, a, at = seg[order], a[order], at[order]
    group = np.concatenate(([0], np.cumsum((anchors[seg][1:] != anchors[seg][:-1]) | (a[1:] != a[:-1]))))
    several = np.bincount(group)[group] > 1
    seg, a, at, group = seg[several], a[several], at[several], group[several]
    if not len(at):
        return np.zeros((0, 3), np.int64)
    owner = np.full(len(suffixes.b) + 1, -1)
    owner[at] = seg
    ranked = suffixes.sorted(at, group)
    near = np.flatnonzero((group[1:] == group[:-1]) & (suffixes.extension(ranked[:-1], ranked[1:]) >= LENGTH))
    good = np.zeros(len(near), bool)
    for lo in range(0, len(near), 4096):  # compare the bytes: equal hashes may collide
        i, j = ranked[near[lo : lo + 4096]], ranked[near[lo : lo + 4096] + 1]
        span = np.arange(LENGTH)
        good[lo : lo + 4096] = (suffixes.b[i[:, None] + span] == suffixes.b[j[:, None] + span]).all(axis=1)
    hit = np.zeros(len(ranked), bool)
    hit[near[good]] = hit[near[good] + 1] = True
    for g in np.unique(group[near[~good]]):  # a collision may have parted equals: settle the group by its bytes
        own = np.flatnonzero(group == g)
        words = [suffixes.b[p : p + LENGTH].tobytes() for p in ranked[own]]
        hit[own] = [words.count(w) > 1 for w in words]
    found, k = owner[ranked[hit]], a[hit]
    order = np.lexsort((k, found))
    found, k = found[order], k[order]
    if not len(found):
        return np.zeros((0, 3), np.int64)
    cut = np.flatnonzero(np.concatenate(([True], (found[1:] != found[:-1]) | (k[1:] != k[:-1] + 1))))
    return np.stack((found[cut], k[cut], k[np.append(cut[1:], len(k)) - 1]), axis=1)


FOUND = "h long, g long, shape int, low int, high int"


def _sort_bucket(table: pa.Table) -> pa.Table:
    h, g = (table.column(k).to_numpy() for k in ("h", "g"))
    shape = table.column("shape").to_numpy().astype(np.int64)
    rows = repeated_windows([s.as_py() for s in table.column("seg")], h, shape >> 8, shape & 255)
    s = rows[:, 0]
    return pa.table({"h": h[s], "g": g[s], "shape": shape[s].astype(np.int32), "low": rows[:, 1].astype(np.int32), "high": rows[:, 2].astype(np.int32)})


WINDOW = "h long, g long, shape int, at int, w1 long, w2 long"


def _windows(batches):
    """Every window of the segments by two hashes."""
    for batch in batches:
        for h, g, shape, seg in zip(*(batch.column(k).to_pylist() for k in ("h", "g", "shape", "seg")), strict=True):
            b, n = np.frombuffer(seg, np.uint8), shape & 255
            k = np.arange(n)
            w = [mix(Prefix(b, *base).of(k, k + LENGTH)).astype(np.int64) for base in ((), (SEGMENT_BASE,))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, h)), pa.array(np.full(n, g)), pa.array(np.full(n, shape, np.int32)), pa.array(((shape >> 8) + n - 1 - k).astype(np.int32)), pa.array(w[0]), pa.array(w[1])], ["h", "g", "shape", "at", "w1", "w2"])


def _keyed(docs: DataFrame, keep: list) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*keep, text.alias("text"), F.xxhash64(text).alias("x"), F.crc32(text).alias("c"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(x, c, spans) by text key: the byte ranges that repeated strings cover, one row a distinct text that has any."""
    texts = _keyed(docs, [])
    found = texts.filter(F.octet_length("text") >= LENGTH).mapInArrow(_run_rows, RUN)
    often = found.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("h")
    shape = F.col("pos").bitwiseAND(0xFFFF).cast("int")
    rows = written(found.join(often, "h").groupBy("h", "g", "x", "c", "pos").agg(F.count(F.lit(1)).alias("m")))
    rows = rows.withColumn("shape", shape)
    first = F.min(F.struct("x", "c", F.shiftright("pos", 16).alias("first")))
    segments = written(rows.groupBy("h", "g", "shape").agg(F.sum("m").alias("m"), first.alias("rep")))
    whole = segments.filter("m > 1").select("h", "g", "shape", F.shiftright("shape", 8).alias("low"), (F.shiftright("shape", 8) + F.col("shape").bitwiseAND(255) - 1).alias("high"))
    several = segments.groupBy("h").agg(F.count(F.lit(1)).alias("segments")).filter("segments > 1")
    asked = segments.join(several, "h").select("h", "g", "shape", "segments", "rep.*")
    wanted = saved(asked.groupBy("x", "c").agg(F.collect_list(F.struct("h", "g", "shape", F.col("first").cast("int").alias("first"))).alias("asked")))
    # one copy of each text that is needed; a fixed-size bit filter drops most others before the shuffle
    near = texts.filter(BitFilter(wanted, "x").may_hold(F.col("x"))).join(wanted.select("x", "c"), ["x", "c"], "left_semi").groupBy("x", "c").agg(F.first("text").alias("text"))
    bytes_of = written(near.join(wanted, ["x", "c"]).select("text", "asked").mapInArrow(_segments, SEGMENT))
    bytes_of = bytes_of.join(several, "h")
    size = bytes_of.filter(F.col("segments") <= HOT).agg(F.coalesce(F.sum(F.octet_length("seg")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, -(-size // SORTED_BYTES))
    cold = bytes_of.filter(F.col("segments") <= HOT).select(F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("bucket"), "h", "g", "shape", "seg")
    parts = cold.groupBy("bucket").applyInArrow(_sort_bucket, FOUND)
    windows = bytes_of.filter(F.col("segments") > HOT).select("h", "g", "shape", "seg").mapInArrow(_windows, WINDOW)
    twice = windows.groupBy("h", "at", "w1", "w2").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    hot = windows.join(twice, ["h", "at", "w1", "w2"]).select("h", "g", "shape", F.col("at").alias("low"), F.col("at").alias("high"))
    covered = whole.union(parts).union(hot)
    # the anchor's place is that of the first window plus the greatest offset
    place = F.shiftright("pos", 16) + F.shiftright("shape", 8) + F.col("shape").bitwiseAND(255) - 1
    spans = rows.join(covered, ["h", "g", "shape"]).select("x", "c", F.struct((place - F.col("high")).cast("int").alias("a"), (place - F.col("low") + LENGTH).cast("int").alias("b")).alias("s"))
    return spans.groupBy("x", "c").agg(F.sort_array(F.collect_set("s")).alias("spans"))


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows with their spans; a fixed-size bit filter keeps most texts without any out of the shuffle."""
    spans = written(spans)
    may = BitFilter(spans, "x").may_hold(F.col("x"))
    none = rows.filter(~may).withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    return rows.filter(may).join(spans, ["x", "c"], "left").select(*none.columns).unionByName(none)


def union_of(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in spans or ():
        if out and s["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["b"])
        else:
            out.append([s["a"], s["b"]])
    return [(a, b) for a, b in out]


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in spans)]
    starts = [*(a for a, _ in spans), len(text)]
    return b"".join(text[e:s] for e, s in zip(ends, starts, strict=True))


def _report(batches):
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            b, cut = text.as_buffer().to_pybytes(), union_of(spans.as_py())
            out.append((len(b), sum(y - x for x, y in cut), len(cut), hashlib.sha256(kept_bytes(b, cut)).hexdigest()))
        cols = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, pa.int64()) for v in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def report(docs: DataFrame) -> DataFrame:
    """What each document loses and a digest of what it keeps."""
    rows = with_spans(_keyed(docs, [F.col("doc_id").cast("long").alias("doc_id")]), repeated_spans(docs))
    return rows.select("doc_id", "text", "spans").mapInArrow(_report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with the repeated strings cut out of text."""

    @F.arrow_udf("string")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([None if t is None else kept_bytes(t.encode(), union_of(s)).decode("utf-8", "ignore") if s else t for t, s in zip(text.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    names = docs.columns
    rows = with_spans(_keyed(docs, [F.struct(*names).alias("__row")]), repeated_spans(docs))
    return rows.withColumn("__new", cut(F.col("__row.text"), F.col("spans"))).select(*(F.col("__new").alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in names))


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from levelframe.session import table

    return report(table(spark, sf_dir, "documents"))
