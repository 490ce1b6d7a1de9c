"""Hard negatives, the prefix trie and packing against brute force on small made tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelframe.llm import hard_negatives, packing, prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# hard negatives


def brute_negatives(rows, step=5, positives=5, negatives=3):
    fine = [(i, y, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, y, v in rows if None not in (i, y, v) and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for i, y, v in sorted(fine):
        if i % step == 0:
            anchors.setdefault(i, (y, v))
    out = Counter()
    for a, (y, v) in anchors.items():
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=False)), i, z) for i, z, w in fine)
        near = [(-s, i) for s, i, z in scored if z == y and i != a][:positives]
        for score, p in near:
            inside = [(-s, i) for s, i, z in scored if z != y and 50 * score <= -100 * s <= 95 * score][:negatives]
            out.update((a, p, k + 1, i, score, s) for k, (s, i) in enumerate(inside))
    return out


def made_vectors(n=400):
    rng = np.random.default_rng(3)
    centre = rng.normal(0, 0.3, 8)
    rows = [(k, int(rng.integers(0, 4)), (centre * rng.uniform(0.3, 1.2) + rng.normal(0, 0.1, 8)).astype(np.float32).tolist()) for k in range(n)]
    rows += [(k, r[1] if k % 2 else 1, r[2]) for k, r in zip(range(n, n + 60), rows, strict=False)]  # ties
    rows += [rows[10], rows[10], (10, 3, rows[12][2]), rows[7], rows[7]]
    rows += [(None, 1, rows[0][2]), (5001, None, rows[0][2]), (5005, 1, None), (5010, 2, [1.0, None]), (5015, 1, [float("nan")] * 8), (5020, 1, [float("inf")] * 8), (5025, 1, []), (5030, 1, rows[3][2][:5])]
    return rows


@pytest.mark.parametrize("cell", [(4096, 2048, 1024), (30, 200, 64), (9, 1000, 3)])
def test_negatives_equal_brute_force(spark, monkeypatch, cell):
    for name, value in zip(("ANCHORS", "ROWS", "AT_ONCE"), cell, strict=True):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = made_vectors(400 if cell[0] > 9 else 60)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({c: F.lit(1) for c in ("vector", "cell", "part", "block", "score", "limits", "slot")}).repartition(3)
    got = Counter(tuple(r) for r in hard_negatives.mined(df, F.col("vec_id") % 5 == 0).collect())
    assert got == brute_negatives(rows) and len(got) > 100


def test_negatives_of_large_components_and_none(spark):
    kind = "vec_id long, label int, embedding array<float>"
    rows = [(0, 0, [2.0**20, 1.0]), (1, 0, [2.0**20, 0.0]), (2, 1, [2.0**20 * 0.9, 0.0]), (3, 1, [2.0**20 * 0.9, 1 / 256])]
    got = [tuple(r) for r in hard_negatives.mined(spark.createDataFrame(rows, kind), F.col("vec_id") == 0).collect()]
    assert Counter(got) == brute_negatives(rows, 10) and len(got) == 2
    assert hard_negatives.mined(spark.createDataFrame([], kind), F.col("vec_id") == 0).collect() == []
    with pytest.raises(Exception, match="beyond 64 bits"):
        hard_negatives.mined(spark.createDataFrame([(0, 0, [2.0**30]), (1, 0, [2.0**30])], kind), F.col("vec_id") == 0).collect()


# prefix trie


def brute_trie(rows, step=20):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, step)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    sums = defaultdict(lambda: [0, 0])
    for k, c in members.items():
        for d in range(len(k) + 1):
            s = sums[k[:d]]
            s[0] += not kids[k]
            s[1] += (len(c) - 1) * len(WORD.findall(k[-1][1])) if k else 0
    ended = defaultdict(list)
    for c, turns in built.items():
        ended[tuple(turns)].append(c)
    return Counter((min(c), len(k), min(members[k[:-1]]) if k else None, len(c), kids[k], *sums[k], hashlib.sha256(",".join(map(str, sorted(ended[k]))).encode()).hexdigest()) for k, c in members.items())


def made_conversations():
    rng = np.random.default_rng(5)
    rows = []
    for c in range(200):
        n = int(rng.integers(1, 14))
        rows += [(c, k, ("user", "assistant")[k % 2], f"t{rng.integers(0, 2)} a  b" if k < 9 else f"end {c % 3}") for k in range(n)]
    for c in range(200, 260):  # copies
        rows += [(c, k, "user", f"copy {k} x y") for k in range(10)]
    rows += [(300, k, None, f"long {k}") for k in range(260)] + [(301, k, None, f"long {k}") for k in range(250)]
    rows += [(400, None, "user", "a"), (400, None, "user", None), (400, 1, None, "b"), (400, 1, None, "b"), (400, 0, "", "z" * 300_000), (None, 1, "user", "a"), (-7, 0, "u", "t"), (399, 0, "user", ""), (10_000_000_019, 0, "u", "one turn")]
    return rows


def test_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "TURN_RANGE", 64)
    rows = made_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("depth", "block", "digest", "words", "pos", "range", "turns", "length", "key1")}).repartition(3)
    got = prefix_trie.trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == brute_trie(rows)


def test_trie_of_nothing(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(spark.createDataFrame([], kind)).collect() == [] == prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "b")], kind)).collect()


# packing


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(6)
    odd = ["It's Bob's; 'sunny' don't!", "Å H̱ ẖ <|endoftext|> x<|ENDOFTEXT|>y Z<|startoftext|>", "3.14,(e)[f] a≠b 'Re l'Ll  x y\x1cz 你好，BC", "İstanbul École ẞß naïve...“q”", "#$%&*\"''\"a'.s x_y-z ~^@ é É. \U0001f600ok", "ﬁn Å Ω"]
    alphabet = list("abcXYZ'.,;:!?()\"-<|> 0123é̱́\n\t'ssdmlt")
    odd += ["".join(rng.choice(alphabet, 300)) for _ in range(60)]
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 500, int(rng.integers(1, 1500))))) for k in range(150)]
    rows += [(1000 + k, t) for k, t in enumerate(odd)] + [(2000, None), (2001, ""), (2002, " \n"), (None, "no id"), (2003, "word " * 30_000)]
    return rows + rows[:3] + [(3000 + k, "the same text of a group of copies") for k in range(400)]


def test_packing_keeps_every_id_once(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("length", "start", "low", "__rank", "many", "offset", "ids")}).repartition(3)
    got = packing.packed(df).collect()
    want = defaultdict(list)
    for i, t in texts:
        want[i].append([*encode(t or "", add_special_tokens=False).ids, 1])
    by = defaultdict(lambda: defaultdict(list))
    for r in got:
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by[r.doc_id][r.start].append(r.ids)
    for i, every in want.items():
        pieces = by[i]
        assert all(len(p) == len(every) for p in pieces.values())  # repeated rows are alike
        assert [x for start in sorted(pieces) for x in pieces[start][0]] == every[0]
    assert {r.doc_id: r.doc_tokens for r in got} == {i: len(v[0]) for i, v in want.items()} and set(by) == set(want)
    packs = defaultdict(list)
    for r in got:
        packs[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for p in packs.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 2048 - at if at & (at - 1) else 0
    assert sorted(packs) == list(range(len(packs))) and padding < 2048
    joined = packing.sequences(packing.packed(df)).collect()
    assert sum(len(r.ids) for r in joined) == sum(r.length for r in got) and all(sum(r.lengths) == len(r.ids) for r in joined)


def test_words_that_a_worker_forgets(monkeypatch, texts):
    import pyarrow as pa

    b = [t or "" for _, t in texts]
    raw = np.frombuffer("".join(b).encode(), np.uint8)
    at = np.concatenate(([0], np.cumsum([len(x.encode()) for x in b])))
    whole = packing.Words(packing.VOCABULARY).tokens(raw, at)
    monkeypatch.setattr(packing, "KEPT_WORDS", 40)
    few = packing.Words(packing.VOCABULARY)
    for k in range(0, len(b), 50):
        m = min(k + 50, len(b))
        ids, begin = few.tokens(raw[at[k] : at[m]], at[k : m + 1] - at[k])
        assert (ids == whole[0][whole[1][k] : whole[1][m]]).all() and (begin == whole[1][k : m + 1] - whole[1][k]).all()
    assert pa.array(b).null_count == 0


def brute_patterns(lengths, sequence):
    """Piece by piece: longest first, each into the shortest pack if it has room."""
    packs = []
    for n in sorted(lengths, reverse=True):
        k = min(range(len(packs)), key=lambda i: sum(packs[i]), default=None)
        if k is None or sum(packs[k]) + n > sequence:
            packs.append([n])
        else:
            packs[k].append(n)
    return Counter(sum(p) for p in packs)


@pytest.mark.parametrize("seed", range(8))
def test_patterns_pack_like_piece_by_piece(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, int(rng.integers(1, 300))).tolist() + [int(rng.integers(1, 65))] * int(rng.integers(0, 200))
    found = packing.patterns(Counter(lengths), 64)
    placed = Counter()
    for pattern, count in found:
        for n, many in pattern:
            placed[n] += many * count
    assert placed == Counter(lengths) and all(len(p) <= 11 for p, _ in found)
    totals = Counter()
    for pattern, count in found:
        totals[sum(n * many for n, many in pattern)] += count
    assert totals == brute_patterns(lengths, 64)


def test_packing_of_nothing(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id string, text string")).collect() == []


# quality limits


def quality_docs(spark, shares):
    """Documents of ten lines; shares: source -> how many of 400 have two lines repeated."""
    rng = np.random.default_rng(9)
    line = lambda: " ".join(f"w{x}" for x in rng.integers(0, 5000, 8))
    rows, k = [], 0
    for source, many in shares.items():
        for i in range(400):
            lines = [line() for _ in range(8)] + [f"end{k}", f"stop{k}"]
            if i < many:
                lines[0], lines[4] = lines[8:]
            rows.append((k, "\n".join(lines), "en", source, 1))
            k += 1
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), rows


def test_limits_follow_the_group(spark):
    from levelframe.llm import quality_rules

    df, rows = quality_docs(spark, {"plain": 2, "verse": 200, "other": 0})
    got = {r.doc_id: r for r in quality_rules.judged(df, ["doc_id"]).collect()}
    odd = {r[0] for r in rows if len(set(r[1].split("\n"))) == 8}  # of ten lines
    dropped = {i for i, r in got.items() if not r.kept}
    # the same document is odd where few repeat lines and usual where many do; any one limit would drop both or none
    assert dropped == {i for i in odd if rows[i][3] == "plain"} and len(dropped) == 2
    again = {r.doc_id: (r.max_dup_line_ratio, r.max_long_word) for r in quality_rules.judged(df.repartition(7), ["doc_id"]).collect()}
    assert again == {i: (r.max_dup_line_ratio, r.max_long_word) for i, r in got.items()}


def test_limits_against_sorted_values(spark):
    from levelframe.llm import quality_rules

    df, _ = quality_docs(spark, {"a": 100, "b": 9})
    counts = quality_rules.with_ratios(quality_rules.measured(df.withColumns({"__lang": F.col("lang"), "__source": F.col("source")}), ["__lang", "__source"]))
    limits = {r["__source"]: r for r in quality_rules.fences(counts).collect()}
    rows = counts.collect()
    for r in quality_rules.RATIOS:
        gross, least = quality_rules.GROSS[r], quality_rules.LEAST[r]
        high, middle = {}, {}
        for s in ("a", "b", None):
            v = sorted(x[r] for x in rows if s in (None, x["__source"]) and (gross is None or x[r] <= gross))
            high[s], middle[s] = v[math.ceil(0.99 * len(v)) - 1], v[math.ceil(0.5 * len(v)) - 1]
            high[s, "n"] = len(v)
        for s in ("a", "b"):
            lean = lambda q: (high[s, "n"] * q[s] + 100 * q[None]) / (high[s, "n"] + 100)  # noqa: B023, E731
            want = min(max(lean(high), least * lean(middle) if gross is None else least), gross or 1e9)
            assert want / 1.03 <= limits[s][f"max_{r}"] <= want * 1.03


def test_a_group_of_gross_documents_alone(spark):
    from levelframe.llm import quality_rules

    junk = [(k, " ".join(f"w{k}x{i}$$$$" for i in range(80)), "en", "junk", 1) for k in range(50)]
    fine = [(100 + k, " ".join(f"v{k}y{i}" for i in range(80)), "en", None, 1) for k in range(50)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    got = {r.doc_id: r.kept for r in quality_rules.judged(spark.createDataFrame(junk + fine, kind), ["doc_id"]).collect()}
    assert not any(got[k] for k in range(50)) and all(got[100 + k] for k in range(50))
    assert quality_rules.judged(spark.createDataFrame([], kind), ["doc_id"]).collect() == []


# scores


@pytest.mark.parametrize("shard", [4_000_000, 700])
def test_scores_do_not_depend_on_partitions(spark, monkeypatch, shard):
    from levelframe.llm import lm_scoring

    monkeypatch.setattr(lm_scoring, "IDS_A_SHARD", shard)
    rng = np.random.default_rng(11)
    rows = [(f"d{k}", " ".join(f"w{x}" for x in rng.zipf(1.4, int(rng.integers(1, 80))) % 400)) for k in range(80)] + [("null", None), (None, "w1 w2"), ("held", "only here only here")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = [{r.doc_id: r for r in lm_scoring.scored(docs.repartition(n)).collect()} for n in (1, 4)]
    assert set(got[0]) == {r[0] for r in rows}
    for i, r in got[0].items():
        s = got[1][i]
        assert np.isclose(r.score, s.score, rtol=1e-6) and np.isclose(r.base_score, s.base_score, rtol=1e-12) and (r.n_tokens, r.n_known) == (s.n_tokens, s.n_known)
    # base and known by hand, a word that recurs in one text included
    held = lambda i: i is not None and zlib.crc32(i.encode()) % 7 == 2
    train = Counter(w for i, t in rows if not held(i) for w in [*WORD.findall(t or ""), None])
    n, v = sum(train.values()), len(train)
    for i, t in rows[:80] + rows[82:]:
        tokens = [*WORD.findall(t), None]
        assert np.isclose(got[0][i].base_score, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens)) and got[0][i].n_known == sum(train[w] > 0 for w in tokens)


def test_words_are_cut_as_alone_and_once_a_worker():
    import pickle
    from pathlib import Path

    import pyarrow as pa
    from levelframe.llm import lm_scoring

    subwords = lm_scoring.Subwords(Path(lm_scoring.VOCABULARY).read_bytes())
    encoder = subwords.parts[0]
    for words in (["it's", "a", "'ll", "..", "12ab", "\u65e5\u672c"], ["a\u00a0", "b"], ["\u00a0", "a"], ["x\u2003y", "\u3000"], ["x\u00a0", "\u00a0y"], ["\x1cq", "\x85"]):
        ids, n = subwords.cut([w.encode() for w in words])
        alone = [encoder.encode_ordinary(" " + w) for w in words]
        assert n.tolist() == [len(x) for x in alone] and ids.tolist() == [i for x in alone for i in x]
    ids, n = subwords.cut([b"\xff\xe6", b"a"])
    assert ids.tolist() == [*encoder.encode_ordinary(" \ufffd\ufffd"), *encoder.encode_ordinary(" a")]
    # words of texts without blanks between them, long ones, nulls; hashes tell words apart
    texts = ["Ab c", "d", None, "", "e " + "x" * 70 + "Y", "x" * 70 + "y", "x" * 70 + "z\x00", "c\x00", "\n"]
    want = [["ab", "c"], ["d"], [], [], ["e", "x" * 70 + "y"], ["x" * 70 + "y"], ["x" * 70 + "z\x00"], ["c\x00"], []]
    (_, _, kinds, first, index, words), = lm_scoring.worded(pa.array(texts))
    own = [w.decode() for w in words(np.arange(len(kinds)))]
    assert [[own[i] for i in index[a:b]] for a, b in zip(first, first[1:], strict=False)] == want and len(set(own)) == len(own) == 7
    subwords.of(kinds, words)
    copy = pickle.loads(pickle.dumps(subwords))  # as the next task has it

    def never(some):
        raise AssertionError("cut again")

    found, starts, lengths = copy.of(kinds, never)
    assert [found[s : s + n].tolist() for s, n in zip(starts, lengths, strict=True)] == [encoder.encode_ordinary(" " + w) for w in own]


@pytest.mark.parametrize("limit", ["WORDS_AT_ONCE", "WORD_BYTES"])
def test_word_counts_are_handed_on(monkeypatch, limit):
    import pyarrow as pa
    from levelframe.llm import lm_scoring

    texts = [f"a B{k % 5} {'x' * 90}{k % 7} a" for k in range(60)] + [None, " "]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    monkeypatch.setattr(lm_scoring, "TEXT_AT_ONCE", 500)
    want = Counter(w for t in texts for w in (t or "").lower().split())
    for most in (getattr(lm_scoring, limit), 20):
        monkeypatch.setattr(lm_scoring, limit, most)
        out, got = list(lm_scoring._word_counts([batch, batch])), Counter()
        for b in out:
            for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                got[w.decode()] += n
        assert got == {w: 2 * n for w, n in want.items()} and (len(out) > 5) == (most == 20)
    assert len({h for b in out for h in b.column("h").to_pylist()}) == len(want)


def test_scores_of_great_weights(monkeypatch):
    from levelframe.llm import lm_scoring

    rng = np.random.default_rng(8)
    ids, first, heads, kind = rng.integers(0, 9, 150).astype(np.int32), np.array([0, 97, 150]), np.arange(0, 150, 3), np.arange(9) % 5
    model = lm_scoring.Attention(np.bincount(ids, minlength=9), kind, rng.integers(0, 5, (lm_scoring.CLASSES + 1) * 9).astype(float))
    near = model.score(ids, first, heads)
    monkeypatch.setattr(lm_scoring, "bounded", lambda m: False)
    assert np.allclose(model.score(ids, first, heads), near, rtol=1e-5)
    monkeypatch.undo()
    model.p["U"] *= np.float32(500)
    model.p["Q"] *= np.float32(500)
    assert np.isfinite(model.score(ids, first, heads)).all()
    at, there, scored = model.windows(first, lm_scoring.SPAN)
    loss, g = model.step(ids, at, there, scored)
    assert np.isfinite(loss) and all(np.isfinite(v).all() for v in g.values())


def test_texts_are_cut_once_for_training_and_scoring(monkeypatch):
    from pathlib import Path

    import pyarrow as pa
    from levelframe.llm import lm_scoring

    subwords = lm_scoring.Subwords(Path(lm_scoring.VOCABULARY).read_bytes())
    encoder, size = subwords.parts[0], subwords.size
    texts = ["Ab c it's", None, "", "unhyphenated \u65e5\u672c a\u00a0b", " \n", *[f"w{k} of{k} " * (k % 9) for k in range(700)]]
    want = [[i for w in WORD.findall((t or "").lower()) for i in encoder.encode_ordinary(" " + w)] for t in texts]
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array([False] * n), pa.array(range(n)), pa.array(texts)], ["__rid", "doc_id", "held_out", "key", "text"])
    cut = list(lm_scoring.cutter(subwords, (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0)([batch]))
    assert [np.frombuffer(x, subwords.kind).tolist() for b in cut for x in b.column("ids").to_pylist()] == want
    assert all(subwords.heads[x[0]] for x in want if x) and sum(subwords.heads[i] for x in want for i in x) == sum(len(WORD.findall(t or "")) for t in texts)

    def never(*_):
        raise AssertionError("cut again")

    monkeypatch.setattr(lm_scoring.Subwords, "of", never)
    monkeypatch.setattr(lm_scoring, "worded", never)
    turns = list(lm_scoring.in_turns(cut, subwords))
    assert [ids[a:b].tolist() for ids, first in turns for a, b in zip(first, first[1:], strict=False)] == [[size - 1, *x, size - 1] for x in want]
    counts = np.bincount(np.concatenate(turns[0][:1]), minlength=size)
    model = lm_scoring.Attention(counts, np.arange(size) % lm_scoring.CLASSES, np.zeros((lm_scoring.CLASSES + 1) * size))
    got = np.concatenate([b.column("score").to_numpy() for b in lm_scoring.scorer(subwords, model)([b.select(["__rid", "ids"]) for b in cut])])
    for k in (0, 1, 3, n - 1):
        ids = np.array([size - 1, *want[k], size - 1], np.int32)
        assert np.isclose(got[k], model.score(ids, np.array([0, len(ids)]), np.flatnonzero(subwords.heads[ids]))[0], rtol=1e-5)


def test_words_that_share_a_place_keep_their_ids(monkeypatch):
    from pathlib import Path

    import pyarrow as pa
    from levelframe.llm import lm_scoring

    monkeypatch.setattr(lm_scoring, "PLACES", 8)
    monkeypatch.setattr(lm_scoring, "KNOWN_IDS", 500)
    subwords = lm_scoring.Subwords(Path(lm_scoring.VOCABULARY).read_bytes() + b"\n")  # a worker's own
    for lo in (0, 10, 0, 30):
        (_, _, kinds, _, _, words), = lm_scoring.worded(pa.array([" ".join(f"v{k}x" for k in range(lo, lo + 40))]))
        ids, starts, lengths = subwords.of(kinds, words)
        assert [ids[a : a + m].tolist() for a, m in zip(starts, lengths, strict=True)] == [subwords.parts[0].encode_ordinary(f" v{k}x") for k in range(lo, lo + 40)]


@pytest.mark.parametrize("places", [32, 16])
def test_gradients_do_not_depend_on_the_way(monkeypatch, places):
    from levelframe.llm import lm_scoring

    rng = np.random.default_rng(8)
    ids, first, kind = rng.integers(0, 9, 150).astype(np.int32), np.array([0, 97, 150]), np.arange(9) % 5
    model = lm_scoring.Attention(np.bincount(ids, minlength=9), kind, np.zeros((lm_scoring.CLASSES + 1) * 9))
    at, there, scored = model.windows(first, places)
    loss, g = model.step(ids, at, there, scored)
    monkeypatch.setattr(lm_scoring, "bounded", lambda m, most=60: False)
    other, h = model.step(ids, at, there, scored)
    assert np.isclose(loss, other, rtol=1e-5) and all(np.allclose(g[k], h[k], rtol=1e-3, atol=1e-6) for k in g)


# language


def slow_places(text):
    """The places of all n-grams of a text, one character at a time."""
    mask, chars = (1 << 32) - 1, []
    for c in map(ord, text):
        letter = 97 <= (c | 32) <= 122 or c >= 0xC0
        chars.append((c + 32 * (65 <= c <= 90 or 0xC0 <= c <= 0xDE)) if letter else 32)
    out = []
    for k in range(3):
        for i in range(len(chars) - k):
            s = sum(chars[i + j] * ((2654435761 * (2 * j + 1)) & mask) for j in range(k + 1)) & mask
            m = (((s ^ (s >> 15)) * 2246822519) + (k * 374761393 & mask)) & mask
            out.append(((m * 3266489917) & mask) >> 17)
    return out


def test_language_against_plain_training_and_prediction(spark):
    from levelframe.llm import language_id as li

    rng = np.random.default_rng(13)
    make = lambda parts, n: " ".join("".join(rng.choice(parts, 3)) for _ in range(n))
    rows = [(k, make(["tha", "ing", "oh"] if k % 2 else ["ich", "ün", "sch"], 12 + k % 9), "en" if k % 2 else "de") for k in range(60)]
    rows += [(900, "12 ... 34", "en"), (901, None, "de"), (902, "Zß É " * 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    own = [(i, t, y) for i, t, y in rows if t is not None and y is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    df = Counter(p for _, t, _ in own for p in set(slow_places(t)))
    idf = lambda p: math.log((1 + len(own)) / (1 + df[p])) + 1
    # the order of training is by Spark's hash of the sample
    h = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.lit("language sample"), "doc_id", F.crc32("text")).alias("h")).collect()}
    z, n, langs = defaultdict(float), defaultdict(float), ["de", "en"]

    def weight(p, j):
        v = z[p, j]
        return 0.0 if abs(v) <= li.L1 else -(v - math.copysign(li.L1, v)) / ((li.BETA + math.sqrt(n[p, j])) / li.ALPHA + li.L2)

    def values(t):
        c = Counter(slow_places(t))
        return {p: li.SCALE * k / max(sum(c.values()), 1) * idf(p) for p, k in c.items()} | {"bias": 1.0}

    def logits(x):
        return [sum(v * weight(p, j) for p, v in x.items()) for j in range(2)]

    def shares(u):
        e = [math.exp(v - max(u)) for v in u]
        return [v / sum(e) for v in e]

    ordered = sorted(((h[i], values(t), langs.index(y)) for i, t, y in own), key=lambda r: r[0])
    for _ in range(li.PASSES):
        for key, x, y in ordered:
            if key % 5 == 0:
                continue
            p = shares(logits(x))
            w = {(k, j): weight(k, j) for k in x for j in range(2)}
            for k, v in x.items():
                for j in range(2):
                    g = v * (p[j] - (j == y))
                    z[k, j] += g - (math.sqrt(n[k, j] + g * g) - math.sqrt(n[k, j])) / li.ALPHA * w[k, j]
                    n[k, j] += g * g
    tests = [(logits(x), y) for key, x, y in ordered if key % 5 == 0]
    loss = lambda t: -sum(math.log(max(shares([v / t for v in u])[y], 1e-12)) for u, y in tests)
    best = min(np.geomspace(0.1, 10, 61), key=lambda t: (round(loss(t), 9), t)) if tests else 1.0
    got = {r.doc_id: r for r in li.predicted(docs).collect()}
    for i, t, _ in rows:
        if i in (900, 901):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
        else:
            p = shares([v / best for v in logits(values(t))])
            assert got[i].lang_pred == langs[p.index(max(p))] and abs(got[i].score - max(p)) < 1e-4
