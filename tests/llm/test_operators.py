"""The operators for training text against brute force on small made tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from levelframe.llm import decontaminate, language_id, lm_scoring, mixing, near_dedup, pii, quality_rules, sharding, suffix_dedup, url_filter

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{k}" for k in rng.integers(0, vocabulary, n)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    base = words(rng, 80, 5000)
    passage = " ".join(words(rng, 60, 5000))
    out = []
    for k in range(60):
        out.append((k, " ".join(words(rng, int(rng.integers(3, 120)), 5000)), "en" if k % 3 else "de", f"s{k % 4}"))
    for k in range(60, 80):  # near copies
        own = list(base)
        own[int(rng.integers(0, 80))] = f"edit{k}"
        out.append((k, " ".join(own), "en", "s0"))
    for k in range(80, 86):  # exact copies
        out.append((k, out[5][1], "en", "s1"))
    for k in range(86, 92):  # a shared passage
        out.append((k, " ".join(words(rng, 90, 5000)) + " " + passage + " " + " ".join(words(rng, 40, 5000)), None, None))
    out += [(92, None, "en", "s0"), (93, "", "en", "s0"), (94, " \n\t ", None, "s2"), (95, "one two", "en", "s2"), (96, "One  TWO", "en", "s2"), (97, "x" * 5000, "en", "s1"), (98, "é ü ñ " * 90, "es", "s1")]
    return [(a, t, lang, s, None if t is None else len(t)) for a, t, lang, s in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df.createOrReplaceTempView("made")
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding_law_slots_and_groups(docs, rows):
    got = sharding.assigned(docs, ["doc_id"], shards=7).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    sizes = Counter(r["shard"] for r in got)
    assert len(sizes) == 7 and max(sizes.values()) - min(sizes.values()) <= 1
    for k in sizes:
        assert sorted(r.slot for r in got if r["shard"] == k) == list(range(sizes[k]))
    copies = {r["shard"] for r in got if r.doc_id in (5, *range(80, 86))}
    assert len(copies) == 1
    by = {r.doc_id: r for r in got}
    assert by[92].size == 8 and by[92].text_crc32 is None and by[98].size == len("é ü ñ ".encode()) * 90 + 8 and by[95].text_crc32 == zlib.crc32(b"one two")


def test_sharding_splits_a_large_group(spark):
    df = spark.createDataFrame([(k, "same" if k < 60 else f"t{k}", "en", "s", 4) for k in range(120)], SCHEMA)
    got = sharding.assigned(df, ["doc_id"], shards=6).collect()
    assert set(Counter(r["shard"] for r in got).values()) == {20}
    assert len({r["shard"] for r in got if r.doc_id < 60}) <= 4


def test_url_rules_and_lists(spark):
    urls = ["http://a.example.com/en/1", "https://example.com/en/7x?y", "http://x.net/de/8", "http://www.example.net/de/81", "http://ORG/es/q", "http://notcom/en/1", None, "no scheme", "http://m.a.example.com/en/1.html", "http://b.com", "a://b.com/en"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r.page_id: (r.rule, r.verdict, r.host) for r in url_filter.filtered(df, ["page_id"]).collect()}
    assert got[0][:2] == ("com/en/", "block") and got[1][:2] == ("example.com/en/7", "allow") and got[2][:2] == ("net/de/", "allow")
    assert got[3][:2] == ("example.net/de/8", "block") and got[4] == ("org/es/", "block", "org") and got[5][:2] == (None, "allow")
    assert got[6] == got[7] == (None, "allow", "") and got[9][:2] == (None, "allow")
    own = spark.createDataFrame([("b.com",)], "key string")
    assert {r.page_id for r in url_filter.filtered(df, ["page_id"], rules=(("zz", "/", "block"),), listed=own).filter("verdict = 'block'").collect()} == {9}


def test_suffix_dedup_against_brute_force(docs, rows):
    counts = Counter()
    for _, t, *_ in rows:
        b = (t or "").encode()
        counts.update(b[k : k + 200] for k in range(len(b) - 199))
    got = {r.doc_id: r for r in suffix_dedup.report(docs).collect()}
    for i, t, *_ in rows:
        b = (t or "").encode()
        cut = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if counts[b[k : k + 200]] > 1:
                cut[k : k + 200] = True
        spans = int((cut[1:] & ~cut[:-1]).sum() + cut[0])
        kept = bytes(x for x, c in zip(b, cut) if not c)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), int(cut[:-1].sum()), spans, hashlib.sha256(kept).hexdigest()), i


def test_suffix_sort_orders_suffixes():
    rng = np.random.default_rng(0)
    b = rng.integers(97, 99, 3000).astype(np.uint8)
    at = rng.permutation(2000)[:500]
    got = suffix_dedup.Suffixes(b).sorted(at, np.zeros(500, int))
    keys = [b[p : p + suffix_dedup.LENGTH].tobytes() for p in got]
    assert keys == sorted(keys)


def test_hot_anchors_are_counted_by_windows(docs, monkeypatch):
    before = {tuple(r) for r in suffix_dedup.report(docs).collect()}
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    assert {tuple(r) for r in suffix_dedup.report(docs).collect()} == before


def test_near_duplicates_against_brute_force(docs, rows):
    sets = {}
    for i, t, *_ in rows:
        w = BLANK.findall((t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(sets)
    for a in ids:
        for b in ids:
            m = len(sets[a] & sets[b])
            if a < b and m and 100 * m >= 75 * (len(sets[a]) + len(sets[b]) - m):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    got = {r.doc_id: r for r in near_dedup.components(docs).collect()}
    for i in ids:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), find(i), find(i) == i), i
    assert sorted(r.doc_id for r in near_dedup.deduplicated(docs).collect()) == sorted(i for i in ids if find(i) == i)


def test_near_duplicates_of_a_chain(spark):
    # each text shares most words with the next one only
    w = [f"v{k}" for k in range(400)]
    df = spark.createDataFrame([(k, " ".join(w[4 * k : 4 * k + 60]), "en", "s", 1) for k in range(40)], SCHEMA)
    assert {r.component_id for r in near_dedup.components(df).collect()} == {0}


def test_labels_settle_on_shuffled_chains(spark):
    rng = np.random.default_rng(9)
    paths = [[0, *range(49, 0, -1)], [int(x) for x in 1000 + rng.permutation(600)]]
    edges = [(a, b) for p in paths for a, b in zip(p, p[1:])]
    got = {r.v: r.label for r in near_dedup.labelled(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: min(p) for p in paths for v in p}


def test_near_duplicates_of_a_long_shuffled_chain(spark):
    # rolling revisions in random order: each text is linked with its next ones only
    w = [f"v{k}" for k in range(4 * 500 + 60)]
    order = [int(k) for k in np.random.default_rng(10).permutation(500)]
    df = spark.createDataFrame([(k, " ".join(w[4 * at : 4 * at + 50]), "en", "s", 1) for k, at in enumerate(order)], SCHEMA)
    got = near_dedup.components(df).collect()
    assert {r.component_id for r in got} == {0} and [r.doc_id for r in got if r.kept] == [0]


def luhn(d):
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(q) <= 255 for q in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


PRIVATE = ["mail a.b@c.de and x@y.z_w@e.f", "ip 1.2.3.4 256.1.1.1 001.2.3.4.5", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "call +49 (30) 1234-5678, +1 2", "é😀 q@w.e +441234567890", None, ""]


def test_personal_data_base(spark):
    df = spark.createDataFrame(list(enumerate(PRIVATE)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    for i, t in enumerate(PRIVATE):
        e = base_spans(t or "")
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in e)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS[:4]] == [sum(x[1] == k for x in e) for k in range(4)]


def test_terms_that_give_an_entity_away(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(words(rng, 30)) + f" Quentin writes from q{'' if k else ''}@home.org today {k}" for k in range(5)] + [" ".join(words(rng, 30)) + " today" for _ in range(400)] + [f"other{k} p{k}@x.org today" for k in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [s for s in r.spans if s.kind == 4] for r in pii.annotated(df, ["doc_id"]).collect()}
    assert {s.value for s in found[0]} == {"quentin", "writes", "from"} and all(texts[0][s.start : s.end].lower() == s.value for s in found[0])
    assert not any(found[k] for k in range(5, len(texts)))
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert "Quentin" not in clean[0] and "[EMAIL]" in clean[0] and clean[6] == texts[6]


def test_terms_of_a_domain_whose_addresses_differ(spark):
    rng = np.random.default_rng(3)
    pad = lambda n: " ".join(words(rng, n))
    texts = [f"{pad(20)} Kim u{k}@acme.org {pad(300)}" for k in range(6)] + [f"{pad(20)} kim {pad(20)}" for _ in range(2)] + [pad(30) for _ in range(700)]
    got = {r.doc_id: [s for s in r.spans if s.kind == 4] for r in pii.annotated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect()}
    near = sum(BLANK.findall(t.lower()).count("kim") > 0 for t in texts[:6])
    strength = near / sum("kim" in BLANK.findall(t.lower()) for t in texts)
    for k in range(8):
        assert ("kim", strength) in {(s.value, s.strength) for s in got[k]}, k
    assert strength == 0.75 and all(any(s.value == "kim" for s in spans) == (k < 8) for k, spans in got.items())


def test_language_held_out_accuracy(spark):
    rng = np.random.default_rng(4)
    parts = {"aa": ["tho", "ing", "ed", "an"], "bb": ["ñé", "lla", "ado", "os"], "cc": ["sch", "ung", "ei", "keit"]}
    data = [(k, " ".join("".join(rng.choice(p, 3)) for _ in range(20)), lang, "s", 1) for k, (lang, p) in enumerate(list(parts.items()) * 60)]
    data += [(900, None, "aa", "s", 1), (901, "123 !?", "aa", "s", 1), (902, "", None, "s", 1)]
    got = {r.doc_id: r for r in language_id.predicted(spark.createDataFrame(data, SCHEMA)).collect()}
    truth = {k: lang for k, _, lang, *_ in data}
    test = [k for k in range(180) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k].held_out == (k in test) for k in range(180))
    assert np.mean([got[k].lang_pred == truth[k] for k in test]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and {got[k].lang_pred for k in (900, 901, 902)} == {"und"}


def test_every_language_is_learned(spark):
    # more languages than weights that are gathered at once, each with letters of its own
    rng = np.random.default_rng(11)
    parts = {f"l{k:02}": [chr(0x4E00 + 8 * k + j) for j in range(8)] for k in range(70)}
    data = [(k, " ".join("".join(rng.choice(p, 3)) for _ in range(20)), lang, "s", 1) for k, (lang, p) in enumerate(list(parts.items()) * 12)]
    got = {r.doc_id: r for r in language_id.predicted(spark.createDataFrame(data, SCHEMA)).collect()}
    assert {r.lang_pred for r in got.values()} == set(parts)
    assert np.mean([got[k].lang_pred == lang for k, _, lang, *_ in data]) > 0.95


def test_decontamination_against_brute_force(spark, docs, rows):
    alnum = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [(1, " ".join(rows[3][1].split()[2:20]) if len(rows[3][1].split()) > 20 else rows[3][1]), (22, "one TWO!"), (3, rows[61][1]), (4, None), (5, "..."), (6, rows[87][1][:300])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    grams = {}
    for i, t in items:
        w = alnum.findall((t or "").lower())
        for k in range(max(len(w) - 9, 1) if w else 0):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    got = {r.doc_id: r for r in decontaminate.report(docs, bench).collect()}
    dirty = set()
    for i, t, *_ in rows:
        w = alnum.findall((t or "").lower())
        hit, found = set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[tuple(w[k : k + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (len(w), len(hit), len(found), digest, bool(hit)), i
        dirty |= {i} if hit else set()
    assert dirty and {r.doc_id for r in decontaminate.without_contaminated(docs, bench).collect()} == {r[0] for r in rows} - dirty
    cut = {r.doc_id: r.text for r in decontaminate.with_spans_removed(docs, bench).collect()}
    assert cut[95] == "" and cut[0] == rows[0][1]


def test_quality_counts_against_brute_force(docs, rows):
    got = {r.doc_id: r for r in quality_rules.judged(docs, ["doc_id"]).collect()}
    for i, t, *_ in rows:
        t = t or ""
        w = BLANK.findall(t)
        n3 = Counter(zip(w, w[1:], w[2:]))
        cover = {k + d for k, g in enumerate(zip(w, w[1:], w[2:])) if n3[g] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if BLANK.search(x)]
        e = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == e, i
        assert r.base_failed == (e[0] < 50 or 100 * e[4] > 50 * e[0]) and not (r.base_failed and r.kept)


def test_quality_keeps_plain_and_drops_odd_documents(spark):
    rng = np.random.default_rng(5)
    plain = [(k, " ".join(words(rng, 100)), "en", "s", 1) for k in range(150)]
    odd = [(500, " ".join(w + "$$$$" for w in words(rng, 100)), "en", "s", 1)]
    got = {r.doc_id: r.kept for r in quality_rules.judged(spark.createDataFrame(plain + odd, SCHEMA), ["doc_id"]).collect()}
    assert all(got[k] for k in range(150)) and not got[500]


def test_quality_drops_junk_that_is_a_third_of_its_group(spark):
    rng = np.random.default_rng(12)
    lines = lambda n: "\n".join(" ".join(words(rng, 8, 5000)) for _ in range(n))
    rows = [(k, lines(10) + ("\nmore" * 12 if k % 10 < 3 else "\nend"), "en", "s", 1) for k in range(300)]
    got = quality_rules.judged(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()
    assert not any(r.base_failed for r in got) and {r.doc_id for r in got if r.kept} == {k for k in range(300) if k % 10 >= 3}


def test_mixing_targets_and_limits(spark):
    rng = np.random.default_rng(6)
    data = [(k, " ".join(words(rng, int(rng.integers(1, 30)))), "en", [None, "a", "b", "c"][min(3, k % 7)], 1) for k in range(700)] + [(800, None, "en", "a", None)]
    df = spark.createDataFrame(data, SCHEMA)
    got = mixing.taken(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.taken(df).collect()))
    source = {d[0]: d[3] for d in data}
    total = Counter()
    for r in got:
        total[source[r.doc_id]] += r["size"]
    weights = dict(zip(["a", "b", "c", None], [5, 2, 1, 5], strict=True))
    left, free, target = 1.5 * sum(total.values()), set(total), {}
    while over := [s for s in free if left / sum(weights[f] for f in free) * weights[s] > 2 * total[s]]:
        for s in over:
            target[s] = 2 * total[s]
        free -= set(over)
        left = 1.5 * sum(total.values()) - sum(target.values())
    share = left / sum(weights[f] for f in free)
    target |= {s: share * weights[s] for s in free}
    for s in total:
        assert abs(sum(r.taken for r in got if source[r.doc_id] == s) - target[s]) <= 30
    assert all(r.taken <= 2 * r["size"] and abs(r.target - target[source[r.doc_id]]) < 1e-6 for r in got)
    out = mixing.mixed(df, shards=4).groupBy("doc_id").count().collect()
    sizes = {r.doc_id: r["size"] for r in got}
    assert {r.doc_id: r["count"] * sizes[r.doc_id] for r in out if sizes[r.doc_id]} == {r.doc_id: r.taken for r in got if r.taken}


def test_mixing_takes_its_rows_from_the_dealt_draws(spark, tmp_path):
    rng = np.random.default_rng(13)
    data = [(k, " ".join(words(rng, int(rng.integers(1, 30)))), "en", [None, "a", "b", "c"][min(3, k % 7)], 1) for k in range(700)]
    spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(mixing.mixed(df).collect(), key=lambda r: (r.mix_shard, r.mix_key))
    assert [r.doc_id for r in mixing.mix_of(df).collect()] == [r.doc_id for r in rows]
    shards = {d[0]: [] for d in data}
    for r in sorted(rows, key=lambda r: r.mix_pass):
        shards[r.doc_id].append(r.mix_shard)
    got = {r.doc_id: r for r in mixing.op10_mixing(spark, str(tmp_path)).collect()}
    assert {k: got[k].shards for k in got} == shards and all(r.taken == len(r.shards) * r["size"] for r in got.values())


def test_scores_against_brute_force(docs, rows):
    token = {i: [*BLANK.findall((t or "").lower()), "\0"] for i, t, *_ in rows}
    c = Counter(w for i, ws in token.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in lm_scoring.scored(docs).collect():
        w = token[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert np.isclose(r.base_score, sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w)) and r.score < 0


def test_attention_gradients_and_learning():
    rng = np.random.default_rng(7)
    ids = np.tile(np.array([0, 3, 1, 2, 5, 4], np.int32), 60)
    first = np.array([0, 180, 360])
    kind = np.arange(8)
    model = lm_scoring.Attention(np.bincount(ids, minlength=8), kind, np.zeros((lm_scoring.CLASSES + 1) * 8))
    at, there, scored = model.windows(first, lm_scoring.SPAN)
    model.p = {k: w.astype(np.float64) for k, w in model.p.items()}
    _, g = model.step(ids, at, there, scored)
    for name in ("Q", "K", "V", "O", "U", "P"):
        k = tuple(int(rng.integers(0, s)) for s in model.p[name].shape)
        e, keep = 1e-5, model.p[name][k]
        model.p[name][k] = keep + e
        up = model.step(ids, at, there, scored)[0]
        model.p[name][k] = keep - e
        down = model.step(ids, at, there, scored)[0]
        model.p[name][k] = keep
        assert np.isclose((up - down) / (2 * e), g[name][k], rtol=0.05, atol=1e-5), name
    assert scored.sum() == len(ids) - 2  # every id but the first of a text once
    model.p = {k: w.astype(np.float32) for k, w in model.p.items()}
    state = {}
    losses = [x for _ in range(20) for x in model.train(ids, first, state)]
    assert losses[-1] < 0.5 * losses[0]


def test_score_against_a_plain_sum_over_tokens():
    rng = np.random.default_rng(8)
    ids = rng.integers(0, 9, 150).astype(np.int32)
    first = np.array([0, 97, 150])
    heads = np.flatnonzero(rng.random(150) < 0.4)
    kind = np.arange(9) % 5
    model = lm_scoring.Attention(np.bincount(ids, minlength=9), kind, rng.integers(0, 5, (lm_scoring.CLASSES + 1) * 9).astype(float))
    p, span, step, out = model.p, lm_scoring.SPAN, lm_scoring.STEP, []
    for lo, hi in zip(first[:-1], first[1:]):
        total = 0.0
        for place in range(lo + 1, hi):  # the place before it is in the last STEP places of its window
            begin = lo + (place - 1 - lo) // step * step - (span - step)
            inputs = [(q, q - begin) for q in range(max(lo, begin), place)]
            x = [p["E"][model.row[ids[q]]] + p["P"][k] for q, k in inputs]
            weights = np.array([x[-1] @ p["Q"] @ (y @ p["K"]) for y in x]) / lm_scoring.WIDTH**0.5
            weights = np.exp(weights - weights.max())
            seen = sum(w * (y @ p["V"]) for w, y in zip(weights / weights.sum(), x))
            logits = (x[-1] + seen @ p["O"]) @ p["U"] + p["b"]
            before = lm_scoring.CLASSES if place in heads else kind[ids[place - 1]]
            total += logits[kind[ids[place]]] - np.log(np.exp(logits).sum()) + model.within[before][ids[place]]
        out.append(total / np.log(10))
    assert np.allclose(model.score(ids, first, heads), out, rtol=1e-4)


@pytest.mark.parametrize("of", [lambda d: sharding.assigned(d, ["doc_id"]), suffix_dedup.report, near_dedup.components, pii.report, language_id.predicted, lambda d: decontaminate.report(d, d.selectExpr("doc_id AS item_id", "text")), lambda d: quality_rules.judged(d, ["doc_id"]), mixing.taken, mixing.mixed, lm_scoring.scored])
def test_empty_tables(empty, of):
    assert of(empty).count() == 0


def test_rows_keep_clashing_columns(spark, rows):
    more = "x long, c long, h long, key string, label string, size long, spans string, target double, n long, block int"
    df = spark.createDataFrame([(*r, 1, 2, 3, "k", "l", 4, "s", 0.5, 5, 6) for r in rows], f"{SCHEMA}, {more}")
    for of in (near_dedup.deduplicated, language_id.accepted, suffix_dedup.deduplicated, quality_rules.quality_rules, pii.sanitised, mixing.mix_of):
        assert of(df).columns == df.columns
        assert of(df).count() >= 0
