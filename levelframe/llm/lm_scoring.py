"""Language-model scoring: a causal self-attention model over subword ids, and a unigram base over words.

Tokens of a text are its words, ASCII letters in lower case, and one end. The base counts them over all training
documents. The model reads each word as subword ids of a given vocabulary (a word with a blank before it, so that the
words of a batch need be cut only once each) and one end. It gives a subword the probability of its class, from one
layer of causal self-attention over the ids before it, times the subword's share of its class after the class of the
subword before it in the word, from the counts of all training words. The classes group ids with like neighbours in
all training words. Ids beyond the INPUTS most frequent share input rows by rank, ids beyond the NEIGHBOURS most
frequent are classed by rank, and attention predicts CLASSES classes; all ids have their own shares and counts.

The layer is trained here in numpy by back-propagation with Adam, in ROUNDS rounds that take each training document
once, whole, in windows of SPAN ids. A hash deals the documents to rounds and shards; the number of shards follows from
the number of ids alone. In a round every shard is one task's, in the order of the hash, from the weights that the round
starts with, and the shards' weights are averaged by how many ids they saw. So the scores do not depend on how the table
is partitioned, and a shard learns from about as many ids whatever the size of the table. In scoring,
windows of SPAN ids advance by STEP, so that every id is scored once, in the last STEP places of one window, with at
least SPAN - STEP ids before it if the text has them; a batch of windows is one masked attention.

The base needs the count of every word of every document. The most frequent words (at most FREQUENT) go to all tasks;
others, none of them frequent, are counted within each text and joined with their counts by a 64-bit hash.

Words are counted first. Then each text is cut once, and a table keeps its ids and what the base needs; the counts of
ids, every round of training and scoring read the ids alone.

Nulls and edge cases: a null text is empty and has the end alone; a null doc_id is not held out; without training
documents N, V and all counts are 0; repeated rows each count and each get their row; a text of any length is scored
whole; classes of equal score are ordered by id; doc_id may have any type; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import base64
import itertools
import math
from collections.abc import Callable
from copy import copy
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelframe.llm.arena import chunks, mix
from levelframe.llm.common import saved, written

#: Where the subword vocabulary is, by default: ranks of byte strings, one a line. Any path that Spark's readers open.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that this vocabulary cuts text by before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FREQUENT = 1 << 17
WIDTH, SPAN, STEP = 16, 32, 16
#: The most frequent subwords are classes of their own, those with neighbours share classes by them, the
#: rest the last classes by rank; inputs beyond INPUTS share rows.
SINGLES, CLASSES, RESTS, INPUTS = 12, 64, 4, 4096
#: Ids that are grouped by their neighbours, the most frequent.
NEIGHBOURS = 1024
#: Weight of a subword's share of its class whatever stands before.
SMOOTH = 10.0
RATE, BATCH = 0.01, 128
#: Rounds of training, and the ids that a shard is meant for; more shards than MOST_SHARDS grow instead.
ROUNDS, IDS_A_SHARD, MOST_SHARDS = 4, 4_000_000, 1024
#: Weights of one row, where the shards' are averaged.
BLOCK = 1024
TEXT_AT_ONCE = 4 << 20
#: Distinct words, and their bytes, that a task counts before it hands them on.
WORDS_AT_ONCE, WORD_BYTES = 1_000_000, 32 << 20
#: Bytes of a word beyond which it is hashed on its own.
LONG = 64
#: Ids of words that a worker keeps, before it begins anew, and places for words: 36 MB.
KNOWN_IDS, PLACES = 4_000_000, 1 << 20
SEED = 5
#: Rows of one product, where many are multiplied with a small matrix.
ROWS = 64

_parts: dict[int, tuple] = {}


class Known:
    """Ids of the words that a worker met before, each in the place that its hash gives; the latest word takes it."""

    def __init__(self):
        self.hashes, self.starts, self.lengths = np.zeros(PLACES, np.uint64), np.zeros(PLACES, np.int64), np.zeros(PLACES, np.int32)
        self.ids, self.held = np.zeros(KNOWN_IDS, np.int32), 0

    def find(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each word, whether it is there)."""
        at = (kinds & np.uint64(PLACES - 1)).astype(np.int64)
        return at, (self.hashes[at] == kinds) & (self.lengths[at] > 0)

    def add(self, kinds: np.ndarray, at: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """First place in ids of each word."""
        if self.held + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.held], ids))
        self.ids[self.held : self.held + len(ids)] = ids
        starts = self.held + np.cumsum(lengths, dtype=np.int64) - lengths
        self.hashes[at], self.starts[at], self.lengths[at] = kinds, starts, lengths
        self.held += len(ids)
        return starts


class Subwords:
    """Cuts words into ids; pickles as the vocabulary's bytes. A worker keeps the ids of words from task to task."""

    def __init__(self, ranks: bytes):
        self.ranks = ranks

    def __getstate__(self):
        return self.ranks

    def __setstate__(self, ranks):
        self.__init__(ranks)

    @property
    def parts(self) -> tuple:
        """(encoder, bytes of each id, known words, whether an id starts a word)."""
        key = hash(self.ranks)
        if key not in _parts:
            import tiktoken

            lines = (line.split() for line in self.ranks.splitlines() if line)
            ranks = {base64.b64decode(a): int(b) for a, b in lines}
            sizes = np.zeros(max(ranks.values()) + 1, np.int64)
            sizes[list(ranks.values())] = [len(t) for t in ranks]
            heads = np.ones(len(sizes) + 1, bool)
            heads[list(ranks.values())] = [t.startswith(b" ") for t in ranks]
            _parts[key] = tiktoken.Encoding("levelframe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes, Known(), heads
        return _parts[key]

    @property
    def size(self) -> int:
        """Ids, and one more for the end of a text."""
        return self.parts[0].n_vocab + 1

    @property
    def heads(self) -> np.ndarray:
        """Whether an id starts a word, or is the end of a text: a word's first id has the blank, no other has one."""
        return self.parts[3]

    @property
    def kind(self) -> type:
        """The narrowest numbers that hold all ids, for tables of ids."""
        return np.uint16 if self.size <= 1 << 16 else np.int32

    def cut(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each).

        The pattern lets no id span the blank before a word, so that words without blanks of their own are cut as one
        text and parted by the ids' bytes.
        """
        encoder, sizes = self.parts[:2]
        joined = b" " + b" ".join(words)
        text = joined.decode("utf-8", "replace")
        if " " + " ".join(text.split()) == text and text.encode() == joined:
            ids = np.array(encoder.encode_ordinary(text), np.int32)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            at = np.searchsorted(np.cumsum(sizes[ids]), ends) + 1
            return ids, np.diff(at, prepend=0)
        out = [encoder.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words]
        return np.fromiter(itertools.chain.from_iterable(out), np.int32), np.fromiter(map(len, out), np.int64, len(out))

    def of(self, kinds: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first place in them of each word, number of ids of each word); kinds: the distinct words' hashes."""
        known = self.parts[2]
        at, there = known.find(kinds)
        new = np.flatnonzero(~there)
        if len(new) and known.held + 8 * len(new) > KNOWN_IDS:
            known.__init__()
            new = np.arange(len(kinds))
        starts, lengths = known.starts[at], known.lengths[at]
        if len(new):
            found = [self.cut(words(new[lo : lo + 20_000])) for lo in range(0, len(new), 20_000)]
            lengths[new] = np.concatenate([n for _, n in found])
            starts[new] = known.add(kinds[new], at[new], lengths[new], np.concatenate([i for i, _ in found]))
        return known.ids, starts, lengths


Words = Callable[[np.ndarray], list[bytes]]
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
_INSIDE = bytes(x != 32 and not 9 <= x <= 13 for x in range(256))


def bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, number of the first word of each text and, last, of all words); inside: bytes of words."""
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    at = np.unique(offsets[(offsets > 0) & (offsets < len(inside))])
    at = at[inside[at] & inside[at - 1]]  # one text's word ends where the next one's starts
    starts, ends = np.insert(starts, np.searchsorted(starts, at), at), np.insert(ends, np.searchsorted(ends, at), at)
    return starts, ends, np.searchsorted(starts, offsets)


def hashes_of(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each substring, from eight bytes at once."""
    loads = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64))
    some = np.arange(len(starts))
    for lo in range(0, LONG, 8):
        some = some[sizes[some] > lo] if lo else some
        if not len(some):
            break
        bits = 8 * np.minimum(sizes[some] - lo, 8).astype(np.uint64)
        load = loads[starts[some] + lo] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - bits))
        out[some] = mix(out[some] ^ load)
    for k in np.flatnonzero(sizes > LONG).tolist():
        out[k] = int.from_bytes(blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


class Pieces:
    """Some substrings, as a list or as an array."""

    def __init__(self, data: bytes, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends = data, starts, ends

    def __call__(self, some: np.ndarray) -> list[bytes]:
        return [self.data[i:j] for i, j in zip(self.starts[some].tolist(), self.ends[some].tolist(), strict=True)]

    def array(self) -> pa.Array:
        sizes = self.ends - self.starts
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        places = np.repeat(self.starts - offsets[:-1], sizes) + np.arange(offsets[-1])
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.frombuffer(self.data, np.uint8)[places])])


def worded(column: pa.Array):
    """(first row, end row, hashes of the distinct words, first word of each text, index of each word in the distinct
    ones, what gives some of those)."""
    for lo, hi, b, offsets in chunks(column, TEXT_AT_ONCE):
        data = b.tobytes().translate(_LOWER)
        starts, ends, first = bounds(np.frombuffer(data.translate(_INSIDE), bool), offsets)
        coded = pa.array(hashes_of(data, starts, ends)).dictionary_encode()
        kinds, index = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        where = np.empty(len(kinds), np.int64)
        where[index[::-1]] = np.arange(len(index) - 1, -1, -1)
        starts, ends = starts[where], ends[where]
        yield lo, hi, kinds, first, index, Pieces(data, starts, ends)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def _word_counts(batches):
    """Hash, word and count; a word once for about WORDS_AT_ONCE distinct ones of a task, or WORD_BYTES of them."""

    def rows(parts):
        coded = pa.array(np.concatenate([k for k, _, _ in parts])).dictionary_encode()
        kinds, index = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        where = np.empty(len(kinds), np.int64)
        where[index[::-1]] = np.arange(len(index) - 1, -1, -1)
        n = np.bincount(index, np.concatenate([c for _, c, _ in parts]), len(kinds)).astype(np.int64)
        words = pa.concat_arrays([w for _, _, w in parts]).take(pa.array(where))
        for at in range(0, len(kinds), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(kinds[part].view(np.int64)), words[part], pa.array(n[part])], ["h", "word", "n"])

    parts, held, size = [], 0, 0
    for batch in batches:
        for _, _, kinds, _, index, words in worded(batch.column("text")):
            parts.append((kinds, np.bincount(index, minlength=len(kinds)), words.array()))
            held, size = held + len(kinds), size + parts[-1][2].nbytes
            if held > WORDS_AT_ONCE or size > WORD_BYTES:
                yield from rows(parts)
                parts, held, size = [], 0, 0
    if held:
        yield from rows(parts)


def cut_texts(batches, subwords: Subwords):
    """(ids of some texts, first place of each text and, last, of all) from a column of ids."""
    for batch in batches:
        for _, _, b, offsets in chunks(batch.column("ids"), TEXT_AT_ONCE):
            yield np.frombuffer(b.tobytes(), subwords.kind), offsets // subwords.kind().itemsize


def counted(rows: DataFrame, size: int, keys: Callable, subwords: Subwords) -> np.ndarray:
    """How often each key below size occurs; keys: those of some ids. A row a key comes to the driver."""

    def of(batches):
        total = np.zeros(size, np.int64)
        for ids, _ in cut_texts(batches, subwords):
            np.add.at(total, keys(ids), 1)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["id", "n"])

    out = np.zeros(size, np.int64)
    found = rows.select("ids").mapInArrow(of, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return out


def subword_counts(rows: DataFrame, subwords: Subwords, kind: np.ndarray | None = None) -> np.ndarray:
    """How often each id occurs in the training words.

    kind: count by the class of the id before it in the word, too; CLASSES stands for a word's start.
    """
    size = subwords.size
    if kind is None:
        return counted(rows, size, lambda ids: ids, subwords)
    return counted(rows, (CLASSES + 1) * size, lambda ids: size * before_kinds(ids, np.flatnonzero(subwords.heads[ids]), kind) + ids, subwords)


def before_kinds(ids: np.ndarray, heads: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The class of the id before each one; CLASSES at the heads, where a word starts."""
    out = np.empty(len(ids), np.int64)
    out[1:] = kind[ids[:-1]]
    out[heads[heads < len(ids)]] = CLASSES
    return out


def ranks_of(counts: np.ndarray) -> np.ndarray:
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    return rank


def neighbours(rows: DataFrame, subwords: Subwords, rank: np.ndarray) -> np.ndarray:
    """How often the most frequent ids, by rank, follow each other in all training words: a square of NEIGHBOURS."""
    top = NEIGHBOURS
    capped = np.minimum(rank, top - 1)

    def pairs(ids):
        at, r = np.flatnonzero(~subwords.heads[ids]), capped[ids]
        return r[at - 1] * top + r[at]

    return counted(rows, top * top, pairs, subwords).reshape(top, top)


def classes(follow: np.ndarray, counts: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A class for each id: spherical k-means of the ids' neighbours in the training words, on singular vectors of the
    positive pointwise information of an id and the ids on its two sides."""
    top = NEIGHBOURS
    order = np.argsort(-counts, kind="stable")
    bins = np.log2(np.maximum(rank, 64) / 64) / np.log2(max(len(counts), 128) / 64)
    kind = CLASSES - RESTS + np.minimum((bins * RESTS).astype(np.int64), RESTS - 1)
    kind[order[:SINGLES]] = np.arange(SINGLES)
    kind[-1] = 0  # the end of a text
    near = np.concatenate((follow.T, follow), axis=1).astype(np.float32)
    weight = near.sum(axis=1)
    live = np.flatnonzero(weight > 0)
    live = live[(live >= SINGLES) & (live < top - 1) & (live < len(counts))]
    k = min(CLASSES - SINGLES - RESTS, len(live))
    if not k:
        return kind
    expected = weight[:, None] * near.sum(axis=0) / max(near.sum(), 1)
    near = np.log(np.maximum(near / np.maximum(expected, 1e-9), 1))
    del expected
    q = np.linalg.qr(near @ np.random.default_rng(SEED).standard_normal((2 * top, 40)).astype(np.float32))[0]
    for _ in range(2):
        q = np.linalg.qr(near @ (near.T @ q))[0]
    x = q * np.linalg.norm(near.T @ q, axis=0)
    x = x[live] / np.maximum(np.linalg.norm(x[live], axis=1, keepdims=True), 1e-9)
    pull, centre = x * np.sqrt(weight[live])[:, None], x[:k].copy()
    for _ in range(25):
        own = (x @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, pull)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(size > 0, sums / np.maximum(size, 1e-9), centre)
    kind[order[live]] = SINGLES + own
    return kind


#: 1 where a place may look: at itself and the places before it.
CAUSAL = np.tri(SPAN, dtype=np.float32)


class Attention:
    """One layer of causal self-attention, from ids to classes of the next id."""

    def __init__(self, counts: np.ndarray, kind: np.ndarray, after: np.ndarray):
        """counts of the ids, their classes, and the counts of (class before, id)."""
        rng = np.random.default_rng(SEED)
        rank = ranks_of(counts)
        self.kind = kind
        self.row = np.where(rank < INPUTS, rank, INPUTS // 2 + rank % (INPUTS // 2)).astype(np.int32)
        smooth = counts + 0.5
        share = np.bincount(kind, smooth, CLASSES)
        within = smooth / share[kind]
        after = after.reshape(CLASSES + 1, len(counts))
        self.within = np.empty(after.shape, np.float32)
        for c in range(CLASSES + 1):
            self.within[c] = np.log((after[c] + SMOOTH * within) / (np.bincount(kind, after[c], CLASSES)[kind] + SMOOTH))
        normal = lambda *shape: (rng.standard_normal(shape) * 0.3 / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"E": normal(INPUTS, WIDTH) * 10, "P": normal(SPAN, WIDTH), "Q": normal(WIDTH, WIDTH), "K": normal(WIDTH, WIDTH), "V": normal(WIDTH, WIDTH), "O": normal(WIDTH, WIDTH), "U": normal(WIDTH, CLASSES), "b": np.zeros(CLASSES, np.float32)}
        self.p["b"] = np.log(share / share.sum() + 1e-9).astype(np.float32)

    def windows(self, first: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of the window's inputs, places that are there, scored places that are there), the last step places
        being scored; first: the first place of each text and, last, the end of all. Place t predicts place t + 1; a
        text's last place predicts nothing."""
        lengths = np.diff(first) - 1
        per = -(-lengths // step)
        text = np.repeat(np.arange(len(lengths)), per)
        k = np.arange(per.sum()) - np.repeat(np.concatenate(([0], np.cumsum(per)))[:-1], per)
        inside = (k * step - (SPAN - step))[:, None] + np.arange(SPAN)
        there = (inside >= 0) & (inside < lengths[text][:, None])
        return np.where(there, first[text][:, None] + inside, 0), there, there[:, SPAN - step :]

    def folded(self) -> tuple[np.ndarray, np.ndarray]:
        """Q with K and V with O: with them the inputs are looked up and summed as they are."""
        p = self.p
        return (p["Q"] @ p["K"].T) * np.float32(WIDTH**-0.5), p["V"] @ p["O"]

    def forward(self, x: np.ndarray, there: np.ndarray, lead: int, look: np.ndarray, give: np.ndarray):
        """From inputs: all that the backward pass needs, with the logits but for b of the places from lead on last.

        Weights of attention are not divided by their sums; what follows from them is. look, give: folded().
        """
        own = np.ascontiguousarray(x[:, lead:])
        q = times(flat(own), look).reshape(own.shape)
        turned = np.ascontiguousarray(x.transpose(0, 2, 1))
        s, ones, causal = q @ turned, np.ones(SPAN, x.dtype), CAUSAL[lead:]
        # without lead, what is not there comes after all that is, so that the causal mask hides it
        short = np.flatnonzero(~there[:, :lead].all(axis=1)) if lead else np.zeros(0, np.int64)
        with np.errstate(all="ignore"):
            np.exp(s, out=s)
            s *= causal
            if len(short):
                s[short] *= there[short][:, None, :]
            sums = flat(s) @ ones
            if not bounded(np.log(sums)):
                s = q @ turned
                s += np.where(causal > 0, 0, -1e9).astype(s.dtype)
                s[short] += np.where(there[short], 0, -1e9).astype(s.dtype)[:, None, :]
                s -= s.max(axis=2, keepdims=True)
                np.exp(s, out=s)
                sums = flat(s) @ ones
        scale = (1 / sums)[:, None]
        o = flat(s @ x)
        o *= scale
        h = times(o, give)
        h += flat(own)
        return own, turned, q, s, scale, o, h, times(h, self.p["U"])

    def step(self, ids, at, there, scored) -> tuple[float, dict]:
        """Mean loss of a batch of windows, and its gradients."""
        p, lead = self.p, SPAN - scored.shape[1]
        look, give = self.folded()
        rows = self.row.take(ids.take(at))
        x = p["E"].take(rows, axis=0)
        x += p["P"]
        own, turned, q, a, scale, o, h, d = self.forward(x, there, lead, look, give)
        with np.errstate(all="ignore"):
            factor = np.exp(p["b"])
            np.exp(d, out=d)
            sums = d @ factor
            if not (bounded(p["b"], 25) and bounded(np.log(sums), 30)):
                d = times(h, p["U"]) + p["b"]
                d -= d.max(axis=1, keepdims=True)
                np.exp(d, out=d)
                factor = np.ones_like(p["b"])
                sums = d @ factor
        kinds, mine = self.kind.take(ids.take(at[:, lead:].ravel() + 1)), scored.ravel()
        goal = np.arange(len(d)) * CLASSES + kinds
        found, hit = d.ravel().take(goal), factor.take(kinds)
        n = max(int(mine.sum()), 1)
        loss = -np.log(np.maximum(found * hit / sums, 1e-12))[mine].sum() / n
        # gradients of the logits are d times factor, by class, times share, by place
        share = mine / (n * sums)
        share = share.astype(d.dtype)
        d.ravel()[goal] = found - sums / hit
        dh = times(d, np.ascontiguousarray((p["U"] * factor).T))
        dh *= share[:, None]
        g = {"U": across(h * share[:, None], d) * factor, "b": share @ d * factor}
        into = across(o, dh)
        g["V"], g["O"] = into @ p["O"].T, p["V"].T @ into
        do = times(dh, np.ascontiguousarray(give.T))
        do *= scale
        pull = np.einsum("ij,ij->i", do, o)
        do = do.reshape(own.shape)
        da = do @ turned
        flat(da)[...] -= pull[:, None]
        da *= a
        dx = a.transpose(0, 2, 1) @ do
        dx += da.transpose(0, 2, 1) @ q
        dq = flat(da @ x)
        into = across(flat(own), dq) * np.float32(WIDTH**-0.5)
        g["Q"], g["K"] = into @ p["K"], into.T @ p["Q"]
        dh += times(dq, np.ascontiguousarray(look.T))
        dx[:, lead:] += dh.reshape(own.shape)
        if lead:
            dx *= there[:, :, None]
        g["P"] = (np.ones(len(dx), dx.dtype) @ dx.reshape(len(dx), -1)).reshape(p["P"].shape)
        # of the inputs' rows only those that occur
        g["rows"], g["E"] = summed(rows.ravel(), flat(dx))
        return loss, g

    def train(self, ids: np.ndarray, first: np.ndarray, state: dict) -> list[float]:
        """One pass in random order over the windows of some texts; state: what Adam carries on."""
        at, there, scored = self.windows(first, SPAN)
        losses, dense = [], [k for k in self.p if k != "E"]
        if "m" not in state:
            size = sum(self.p[k].size for k in dense)
            state.setdefault("n", 0)
            state.update(t=0, rng=np.random.default_rng(SEED + int(state["n"])), m=[np.zeros(size, np.float32), np.zeros_like(self.p["E"])], s=[np.zeros(size, np.float32), np.zeros_like(self.p["E"])])
        order = state["rng"].permutation(len(at))
        for lo in range(0, len(at), BATCH):
            own = order[lo : lo + BATCH]
            loss, g = self.step(ids, at[own], there[own], scored[own])
            losses.append(float(loss))
            state["n"] += 1
            state["t"] += 1
            n, rate = state["t"], RATE / (1 + state["n"] / 2000) ** 0.5
            # all but the inputs' rows are one array
            for k, (own, d) in enumerate(((slice(None), np.concatenate([g[k].ravel() for k in dense])), (g["rows"], g["E"]))):
                m, s = state["m"][k][own], state["s"][k][own]
                m += np.float32(0.1) * (d - m)
                s += np.float32(0.01) * (d * d - s)
                state["m"][k][own], state["s"][k][own] = m, s
                move = np.float32(rate / (1 - 0.9**n)) * m / (np.sqrt(s * np.float32(1 / (1 - 0.99**n))) + np.float32(1e-6))
                if k:
                    self.p["E"][own] -= move
                    continue
                place = 0
                for name in dense:
                    w = self.p[name]
                    w -= move[place : place + w.size].reshape(w.shape)
                    place += w.size
        return losses

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def set_flat(self, values: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = values[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n

    def score(self, ids: np.ndarray, first: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """log10 probability of each text; heads: the places where words and ends start."""
        at, there, scored = self.windows(first, STEP)
        total = self.within.ravel().take(before_kinds(ids, heads, self.kind) * self.within.shape[1] + ids).astype(np.float64)
        total[first[:-1]] = 0
        rows, goals, more, factor = self.row[ids], self.kind[ids], self.p["b"], np.exp(self.p["b"])
        look, give = self.folded()
        for lo in range(0, len(at), 256):
            part = slice(lo, lo + 256)
            x = self.p["E"].take(rows.take(at[part]), axis=0)
            x += self.p["P"]
            *_, h, logits = self.forward(x, there[part], SPAN - STEP, look, give)
            mine = scored[part].ravel()
            place = at[part][:, SPAN - STEP :].ravel() + 1
            goal = goals.take(place)
            found = logits.ravel().take(np.arange(len(goal)) * CLASSES + goal) + more.take(goal)
            with np.errstate(all="ignore"):
                logs = np.log(np.exp(logits, out=logits) @ factor)
            if not bounded(logs):
                logits = times(h, self.p["U"]) + more
                top = logits.max(axis=1)
                logits -= top[:, None]
                logs = np.log(np.exp(logits, out=logits).sum(axis=1)) + top
            found -= logs
            total[place[mine]] += found[mine]
        sums = np.concatenate(([0.0], np.cumsum(total)))
        return (sums[first[1:]] - sums[first[:-1]]) / np.log(10)


def bounded(m: np.ndarray, most: float = 60) -> bool:
    """Whether sums of exponentials, given as logarithms, lost nothing to the range of the numbers."""
    return m.size == 0 or (m.max() < most and m.min() > -most)


def flat(m: np.ndarray) -> np.ndarray:
    """The last axis of all windows and places, in rows."""
    return m.reshape(-1, m.shape[-1])


def parted(m: np.ndarray) -> np.ndarray:
    """Rows in parts of up to ROWS, as products of small matrices are the faster ones."""
    return m.reshape(-1, math.gcd(len(m), ROWS) or 1, m.shape[-1])


def times(m: np.ndarray, w: np.ndarray) -> np.ndarray:
    """m @ w, for many rows and few columns."""
    return flat(parted(m) @ w)


def across(m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """m.T @ d, for many rows and few columns."""
    return (parted(m).transpose(0, 2, 1) @ parted(d)).sum(axis=0)


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, the sums of their values)."""
    rows = rows.astype(np.uint16)  # INPUTS at most; of 16 bits, so that sorting is by digits
    order = np.argsort(rows, kind="stable")
    heads = np.flatnonzero(np.diff(rows[order], prepend=np.int64(-1)))
    # as pairs, so that one sum takes two columns
    pairs = values.take(order, axis=0).view(np.result_type(values.dtype, np.complex64))
    return rows[order[heads]], np.add.reduceat(pairs, heads, axis=0).view(values.dtype)


def ended(ids: np.ndarray, first: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text as end, its ids, end: (ids, first place of each text and, last, the end of all)."""
    places = first - first[0] + 2 * np.arange(len(first))
    out = np.full(int(places[-1]), end_id, np.int32)
    inside = np.ones(len(out), bool)
    inside[places[:-1]] = inside[places[1:] - 1] = False
    out[inside] = ids[first[0] : first[-1]]
    return out, places


def in_turns(batches, subwords: Subwords):
    """Some texts of a column of ids at once, ended, as inputs take more room than ids."""
    for ids, first in cut_texts(batches, subwords):
        for k in range(0, len(first) - 1, 256):
            yield ended(ids, first[k : k + 257], subwords.size - 1)


RARE = pa.struct([("h", pa.int64()), ("n", pa.int64())])


def cutter(subwords: Subwords, frequent: tuple[np.ndarray, np.ndarray], end_count: int):
    """Of each text: its tokens, how many are known and the base of the frequent words, the other words, and its ids."""
    hashes, counts = frequent

    def of(batches):
        for batch in batches:
            for lo, hi, kinds, first, index, words in worded(batch.column("text")):
                at = np.minimum(np.searchsorted(hashes, kinds), max(len(hashes) - 1, 0))
                c = np.where(hashes[at] == kinds, counts[at], 0) if len(hashes) else np.zeros(len(kinds), np.int64)
                logs = np.where(c > 0, np.log10(c + 1.0), 0.0)
                there = (c > 0)[index]
                sums = np.concatenate(([0.0], np.cumsum(logs[index])))
                seen = np.concatenate(([0], np.cumsum(there)))
                known, base = np.diff(seen[first]) + (end_count > 0), np.diff(sums[first]) + np.log10(end_count + 1.0)
                rest = np.flatnonzero(~there)
                text = np.searchsorted(first, rest, "right") - 1
                # a word once for each text
                own, n = np.unique(text * len(kinds) + index[rest], return_counts=True)
                ends = np.searchsorted(own, np.arange(hi - lo + 1) * len(kinds))
                h = kinds[own % max(len(kinds), 1)]
                entries = pa.StructArray.from_arrays([pa.array(h.astype(np.int64)), pa.array(n.astype(np.int64))], fields=list(RARE))
                # texts are cut in turns, as places take more room than bytes
                ids, starts, lengths = subwords.of(kinds, words)
                parts, sizes = [], []
                for k in range(0, hi - lo, 256):
                    bounds_of = first[k : k + 257]
                    part = index[bounds_of[0] : bounds_of[-1]]
                    many = lengths[part]
                    before = np.concatenate(([0], np.cumsum(many, dtype=np.int64)))
                    parts.append(ids[np.repeat(starts[part] - before[:-1], many) + np.arange(before[-1])].astype(subwords.kind))
                    sizes.append(np.diff(before[bounds_of - bounds_of[0]]))
                ids = np.concatenate(parts)
                places = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))) * ids.itemsize
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(lo, hi - lo) for k in ("__rid", "doc_id", "held_out", "key")),
                        pa.array(np.diff(first) + 1),
                        pa.array(known),
                        pa.array(base),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), entries),
                        pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(ids)]),
                    ],
                    ["__rid", "doc_id", "held_out", "key", "n_tokens", "known", "base", "rare", "ids"],
                )

    return of


def scorer(subwords: Subwords, model: Attention):
    heads = subwords.heads

    def of(batches):
        for batch in batches:
            found = [model.score(ids, first, np.flatnonzero(heads[ids])) for ids, first in in_turns([batch], subwords)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(found) if found else [], pa.float64())], [*batch.schema.names[:-1], "score"])

    return of


def trained(rows: DataFrame, subwords: Subwords, model: Attention, ids: int) -> None:
    """Trains model on the texts of all rows (key, a hash of the row, and ids), of about so many ids: in each round a task
    a shard, and the mean of their weights."""
    shards = min(MOST_SHARDS, max(1, ids // IDS_A_SHARD))
    dealt = rows.select("key", "ids").withColumns({"round": F.pmod("key", F.lit(ROUNDS)), "shard": F.pmod(F.shiftright("key", 8), F.lit(shards)).cast("int")})
    steps = 0.0
    learner = copy(model)
    learner.within = None  # of no use in training

    def of_round(start: np.ndarray, steps: float):
        def of(batches):
            learner.set_flat(start)
            state, seen = {"n": steps}, 0
            for part, places in in_turns(batches, subwords):
                learner.train(part, places, state)
                seen += len(part)
            if seen:
                w = np.append(learner.flat().astype(np.float64), state["n"]) * seen
                parts = [w[at : at + BLOCK] for at in range(0, len(w), BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array(parts, pa.list_(pa.float64())), pa.array(np.full(len(parts), seen))], ["i", "w", "seen"])

        return of

    def mean(part: pa.Table) -> pa.Table:
        w = part.column("w").combine_chunks()
        w = w.values.to_numpy(zero_copy_only=False).reshape(len(part), -1).sum(axis=0) / pc.sum(part.column("seen")).as_py()
        return pa.table({"i": part.column("i")[:1], "w": pa.array([w], pa.list_(pa.float64()))})

    for k in range(ROUNDS):
        part = dealt.filter(F.col("round") == k).select("shard", "key", "ids").repartitionById(shards, F.col("shard")).sortWithinPartitions("key", "ids")
        # a row a block of weights, whatever the number of shards; the last weight is the number of steps
        found = part.select("ids").mapInArrow(of_round(model.flat(), steps), "i long, w array<double>, seen long").groupBy("i").applyInArrow(mean, "i long, w array<double>").orderBy("i").toArrow()
        if found.num_rows:
            weights = found.column("w").combine_chunks().flatten().to_numpy()
            model.set_flat(weights[:-1])
            steps = float(weights[-1])


def frequent_words(counts: DataFrame, limit: int = FREQUENT) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
    """(least count, hashes and counts of the words with it or more): at most limit words."""
    bins = counts.groupBy(F.floor(F.log2(F.col("c").cast("double")) * 8).alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("bin")).collect()  # some hundred rows
    least, n = None, 0
    for r in bins:
        n += r["n"]
        if n > limit:
            break
        least = r["bin"]
    if least is None:
        return 1 << 62, (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    table = counts.filter(F.floor(F.log2(F.col("c").cast("double")) * 8) >= least).select("h", "c").toArrow()
    h = table.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return least, (h[order], table.column("c").to_numpy()[order])


def scored(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    file = docs.sparkSession.read.format("binaryFile").load(vocabulary).select("content").first()  # one file of fixed size
    subwords = Subwords(bytes(file["content"]))
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    own = rows.filter("NOT held_out")
    counts = saved(own.select("text").mapInArrow(_word_counts, "h long, word binary, n long").groupBy("h", "word").agg(F.sum("n").alias("c")).select("h", "c"))
    n_docs = own.count()
    words = counts.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    n, v = words["n"] + n_docs, words["v"] + (n_docs > 0)
    least, frequent = frequent_words(counts)
    # each text is cut once; training and scoring read its ids
    key = F.xxhash64(F.col("doc_id").cast("string"), "text").alias("key")
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = rows.select(F.monotonically_increasing_id().alias("__rid"), "doc_id", "held_out", key, "text").mapInArrow(cutter(subwords, frequent, n_docs), f"__rid long, doc_id {kind}, held_out boolean, key long, n_tokens long, known long, base double, rare array<struct<h:long,n:long>>, ids binary")
    cut = written(cut)
    training = cut.filter("NOT held_out").select("key", "ids")
    ids = subword_counts(training, subwords)
    ids[-1] = n_docs
    rank = ranks_of(ids)
    kinds = classes(neighbours(training, subwords, rank), ids, rank)
    after = subword_counts(training, subwords, kinds)
    after[CLASSES * subwords.size + subwords.size - 1] = n_docs
    model = Attention(ids, kinds, after)
    trained(training, subwords, model, int(ids.sum()))
    found = cut.select("__rid", "doc_id", "held_out", "n_tokens", "known", "base", "ids").mapInArrow(scorer(subwords, model), f"__rid long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double")
    found = saved(found)
    rest = counts.filter(F.floor(F.log2(F.col("c").cast("double")) * 8) < least).select("h", "c")
    rare = cut.select("__rid", F.inline("rare")).withColumnRenamed("n", "times").join(rest, "h").groupBy("__rid").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("times").alias("hits"))
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return found.join(rare, "__rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("hits", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    from levelframe.session import table

    return scored(table(spark, sf_dir, "documents"))
