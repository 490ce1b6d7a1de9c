"""Packing: documents as token sequences of a fixed length with little padding, shortest pack first.

Every document becomes its token ids and an end id, cut into pieces of the sequence's length and one shorter rest.
The pieces' length histogram, one count a length, is all that is planned with: lengths are placed longest first, each
into the shortest packs that have room, as counts of packing patterns. A pattern is a sequence of (length, how many),
so no more than 63 lengths, and each length adds three patterns at most: the plan is bounded by the sequence's length,
not by the documents. Pieces are ranked within their length, and each pattern takes a range of ranks.

Tokens: texts are cut at white space and between ASCII letters and ASCII punctuation, which the tokenizer never joins,
and only words not met before in a worker go through it (told apart by 64-bit hashes); an apostrophe and the signs of
special tokens stay inside.
The vocabulary is a file that the tasks open by name; it is read once a worker.

Nulls and edge cases: a null or empty text is the end id alone; a text of any length is read whole, one text at a time
if it is long; a null doc_id is kept as it is; repeated rows are documents of their own; pieces of equal length are
ranked by a hash of what they are and ties are alike; an empty table gives no rows; columns other than doc_id and text
are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelframe.llm import arena
from levelframe.llm.common import numbered, written

SEQUENCE = 2048
END = 1
VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a worker keeps; with more it starts anew.
KEPT_WORDS = 2_000_000

_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[97:123] = True
_MARK[list(b'.,;:!?()"-*#$%&+=_~^@/[]{}')] = True


class Words:
    """Token ids of words, each encoded once."""

    _open: dict[str, Words] = {}

    def __init__(self, vocabulary: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)).encode_batch_fast
        self._clear()

    @classmethod
    def of(cls, vocabulary: str) -> Words:
        if vocabulary not in cls._open:
            cls._open[vocabulary] = cls(vocabulary)
        return cls._open[vocabulary]

    def _clear(self) -> None:
        self.hashes, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        if len(self.hashes) + len(hashes) > KEPT_WORDS:
            self._clear()
        ids = [e.ids for e in self.encode(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        at = np.concatenate((self.at, len(self.ends) - 1 + np.arange(len(ids))))
        self.ids = np.concatenate((self.ids, np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))
        every = np.concatenate((self.hashes, hashes))
        order = np.argsort(every, kind="stable")
        self.hashes, self.at = every[order], at[order]

    def tokens(self, b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and, last, end)."""
        b = _lowered(b)
        starts, ends, first = _bounds(b, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        every = arena.mix(arena.Prefix(b).of(starts, ends) ^ (ends - starts).astype(np.uint64))
        hashes, where, which = np.unique(every, return_index=True, return_inverse=True)
        new = ~np.isin(hashes, self.hashes, assume_unique=True)
        if new.any():
            if len(self.hashes) + int(new.sum()) > KEPT_WORDS:
                new[:] = True  # the kept words go
            raw, at = b.tobytes(), where[new]
            self._learn(hashes[new], [raw[s:e].decode(errors="replace") for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        word = self.at[np.searchsorted(self.hashes, hashes)][which]
        begin = np.concatenate(([0], np.cumsum(self.ends[word + 1] - self.ends[word])))
        sizes = begin[1:] - begin[:-1]
        return self.ids[np.repeat(self.ends[word] - begin[:-1], sizes) + np.arange(begin[-1])], begin[first]


def _lowered(b: np.ndarray) -> np.ndarray:
    """A to Z in lower case, so that fewer words differ, where the tokenizer does the same later: not before a mark
    that may join the letter first, and not beside what may look like a special token."""
    if b"<|" in b.tobytes():
        return b
    upper = (b >= 65) & (b <= 90)
    upper[:-1] &= b[1:] < 128
    return np.where(upper, b + np.uint8(32), b)


def _bounds(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of what is encoded on its own, and the number of the first of each text and, last, of all."""
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    letter, mark = _LETTER[b], _MARK[b]
    cut = np.zeros(len(b) + 1, bool)
    cut[offsets] = True
    cut[1:-1] |= (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1]) | (inside[1:] != inside[:-1])
    starts = np.flatnonzero(inside & cut[:-1])
    return starts, np.flatnonzero(inside & cut[1:]) + 1, np.searchsorted(starts, offsets)


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, sequence: int = SEQUENCE, end: int = END, ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, and ids if asked for: each document cut at every sequence tokens."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * ids

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words.of(vocabulary)
        for batch in batches:
            texts = batch.column("text")
            for low, high, b, o in arena.chunks(texts):
                tokens, at = words.tokens(b, o)
                # the end id behind each text
                whole = np.insert(tokens, at[1:], end).astype("<u4")
                begin = at + np.arange(len(at))
                sizes = begin[1:] - begin[:-1]
                cuts = -(-sizes // sequence)
                row = np.repeat(np.arange(len(sizes)), cuts)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * sequence
                length = np.minimum(sizes[row] - start, sequence)
                a = begin[row] + start
                view = memoryview(whole.view(np.uint8))
                sums = [zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(a.tolist(), (a + length).tolist(), strict=True)]
                columns = [batch.column("doc_id").slice(low, high - low).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(sizes[row])]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(a, len(whole)).astype(np.int32)), pa.array(whole.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])

    return docs.select("doc_id", "text").mapInArrow(of, schema)


def patterns(histogram: Mapping[int, int], sequence: int = SEQUENCE) -> list[tuple[list[tuple[int, int]], int]]:
    """[(pattern, in how many sequences)]; a pattern is [(length, how many pieces of it)] in the order of placing.

    Longest first, into the shortest packs with room, as if piece by piece: as long as the shortest packs have room
    they take one each, else a new pack takes pieces until it is full.
    """
    packs: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    totals: list[int] = []  # a heap of the totals that packs has

    def put(total: int, pattern: list[tuple[int, int]], count: int) -> None:
        if total not in packs:
            packs[total] = []
            heapq.heappush(totals, total)
        packs[total].append((pattern, count))

    def more(pattern: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
        last, n = pattern[-1]
        return [*pattern[:-1], (last, n + 1)] if last == length else [*pattern, (length, 1)]

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not totals or totals[0] + length > sequence:
                room = sequence // length
                full, rest = divmod(left, room)
                if full:
                    put(length * room, [(length, room)], full)
                if rest:
                    put(length * rest, [(length, rest)], 1)
                break
            total = totals[0]
            pattern, count = packs[total].pop()
            if not packs[total]:
                del packs[total]
                heapq.heappop(totals)
            taken = min(left, count)
            left -= taken
            put(total + length, more(pattern, length), taken)
            if taken < count:
                put(total, pattern, count - taken)
    return [p for total in sorted(packs, reverse=True) for p in packs[total]]


def plan(spark: SparkSession, histogram: Mapping[int, int], sequence: int = SEQUENCE) -> DataFrame:
    """Which ranks of which length go where: length, low, high (exclusive), many (of it in a sequence), first_sequence,
    first_offset."""
    used: dict[int, int] = {}
    rows, at = [], 0
    for pattern, count in patterns(histogram, sequence):
        offset = 0
        for length, many in pattern:
            low = used.get(length, 0)
            used[length] = low + many * count
            rows.append((length, low, used[length], many, at, offset))
            offset += length * many
        at += count
    return spark.createDataFrame(rows, "length long, low long, high long, many long, first_sequence long, first_offset long")


def placed(cut: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces with sequence_id and offset. cut should be a saved table: it is read three times."""
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length
    where = F.broadcast(plan(cut.sparkSession, histogram, sequence))  # 63 rows a pattern and three patterns a length at most
    order = F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = numbered(cut, ["length"], order, "__rank").alias("p")
    out = ranked.join(where.alias("w"), (F.col("p.length") == F.col("w.length")) & (F.col("__rank") >= F.col("low")) & (F.col("__rank") < F.col("high")))
    nth = F.col("__rank") - F.col("low")
    return out.select(
        *(F.col(f"p.{c}") for c in cut.columns),
        (F.col("first_sequence") + F.expr("(__rank - low) div many")).alias("sequence_id"),
        (F.col("first_offset") + nth % F.col("many") * F.col("p.length")).alias("offset"),
    )


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, sequence: int = SEQUENCE, end: int = END, ids: bool = True) -> DataFrame:
    """Every piece of every document with its place: pieces() and sequence_id, offset."""
    return placed(written(pieces(docs, vocabulary, sequence, end, ids)), sequence)


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids and lengths of the pieces in order: a sequence is a row of bounded length."""
    piece = F.struct("offset", "doc_id", "length", "ids")
    rows = packed_pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    return rows.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("p", lambda x: x["length"]).alias("lengths"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from levelframe.session import table

    return packed(table(spark, sf_dir, "documents"), ids=False)
