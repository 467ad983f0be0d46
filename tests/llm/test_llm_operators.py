"""Training-data operators against brute force on small, awkward fixtures."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborkit.llm import langid, line_dedup, lm_score, ngram_join, packing, segment_topk, sentencepiece_codec, substring_dedup, toxicity, vptree
from arborkit.llm.common import RepeatSketch, connected_components, pack_ascending, unpack_ascending
from arborkit.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, windows string, bits string"


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def fixture_rows():
    base = words(1, 200, 10**6)
    near = base[:100] + ["Changed"] + base[101:]
    passage = words(2, 60, 10**6)
    texts = [
        " ".join(base), " ".join(base), " ".join(base).upper(), " ".join(near), None, "", "  \n ", "one", "one", "ONE two", "a b c d", "a b c d e",
        " ".join(words(3, 30, 10**6) + passage + words(4, 30, 10**6)), " ".join(passage + words(5, 9, 10**6)), " ".join(passage[:34]), "x " * 120, "naïve space\tTab\x0bvt end",
        " ".join(words(6, 6000)), "line one\nshared footer\nline two", "shared footer", " shared footer ", "<|endoftext|> hi  there ", "x" * 3000, "😀 \x00 ﬁ ▁odd",
    ]
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i}", None, "w", "b") for i, t in enumerate(texts)]
    return rows + [rows[0], (None, "no id here", None, None, None, None, None), (None, None, None, None, None, None, None), (None, " ".join(near), "en", "s1", 1, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")


def same(got, want):
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, want))


def split(text):
    return text.encode().split() if text else []


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_ngram_join(docs, empty, k, percent):
    def shingles(text):
        w = [x.lower() for x in split(text)]
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    rows = fixture_rows()
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up = [up[j] if x == up[i] else x for x in up]
    name = {u: min((r[0] for r, x in zip(rows, up) if x == u and r[0] is not None), default=None) for u in up}
    want = [(r[0], len(s), name[u] if s else r[0]) for r, s, u in zip(rows, sets, up)]
    same(ngram_join.ngram_jaccard_components(docs, k, percent).collect(), want)
    assert ngram_join.ngram_jaccard_components(empty, k, percent).count() == 0


def test_ngram_join_splits_large_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "CLUSTER_ELEMENTS", 3000)
    r = random.Random(9)
    base = words(7, 150, 10**6)
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(8)):
            w[r.randrange(150)] = f"z{r.random()}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(147)} for i, t in rows}
    up = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and up[i] != up[j]:
                low, high = sorted((up[i], up[j]))
                up = {x: low if u == high else u for x, u in up.items()}
    got = ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == up and len(set(up.values())) > 1


def test_dual_traversal_finds_every_pair():
    r = np.random.default_rng(3)
    pool = r.integers(1, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(r.choice(pool, int(n))) for n in r.integers(5, 200, 80)]
    sets += [np.unique(np.concatenate([s[: int(len(s) * 0.95)], r.integers(1, 2**63, 3, dtype=np.uint64)])) for s in sets[:40]]
    sizes = np.array([len(s) for s in sets])
    bits = [ngram_join.bitmap(s, ngram_join.bitmap_width(len(s), 2)) for s in sets]
    found = {tuple(sorted(p)) for a, b in ngram_join.links_by_width(bits, sizes, np.zeros(len(sets), int), 80) for p in zip(a.tolist(), b.tolist())}
    true = {(j, i) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert true and true <= found and len(found) < 80 * 119 / 2


def brute_windows(rows, k):
    count = collections.Counter(tuple(w[i : i + k]) for w in (split(r[1]) for r in rows) for i in range(len(w) - k + 1))
    for r in rows:
        w = split(r[1])
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if count[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        yield r[0], len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()


@pytest.mark.parametrize("k", [35, 3, 1])
def test_substring_dedup(docs, empty, k):
    got = substring_dedup.judge_windows(docs, k).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    same(got, brute_windows(fixture_rows(), k))
    assert substring_dedup.judge_windows(empty, k).count() == 0


def test_substring_dedup_keeps_columns_and_untouched_texts(docs):
    out = substring_dedup.remove_repeated_windows(docs, 35)
    assert out.columns == docs.columns
    assert {r.text for r in out.collect()} >= {"one", "naïve space\tTab\x0bvt end", None}


def test_repeat_sketch_never_falls_short(spark):
    sketch = RepeatSketch(18)
    keys = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64)
    parts = [keys[:3000], keys[2500:]]
    df = spark.createDataFrame(parts and [(bytes(p.tobytes()),) for p in parts], "keys binary").repartition(2)
    table = sketch.merge(df.mapInArrow(lambda bs: (sketch.emit(np.frombuffer(x, dtype=np.uint64)) for b in bs for x in b.column(0).to_pylist()), "block long, part binary"))
    assert sketch.repeated(table, keys[2500:3000]).all()
    assert sketch.repeated(table, keys[:2000]).mean() < 0.05


def test_connected_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000, 1000 + i) for i in range(50)] + [(i, i + 1) for i in range(2000, 2040)] + [(5, 5), (None, 3)]
    up = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for a, b in edges:
        if None not in (a, b) and a != b and up[a] != up[b]:
            low, high = sorted((up[a], up[b]))
            up = {x: low if u == high else u for x, u in up.items()}
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == up and len(got) == len(up)


@pytest.mark.parametrize("least", [2, 3])
def test_line_dedup(docs, empty, least):
    rows = fixture_rows()
    sites = collections.defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if r[3] is not None:
                sites[line.strip(" ")].add(r[3])
    want = []
    for r in rows:
        lines = r[1].split("\n") if r[1] is not None else []
        kept = [x for x in lines if not x.strip(" ") or len(sites[x.strip(" ")]) < least]
        want.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept) if r[1] is not None else None))
    same(line_dedup.judge_lines(docs, least).select("doc_id", "n_lines", "n_removed", "kept_text").collect(), want)
    assert line_dedup.judge_lines(empty).count() == 0
    assert line_dedup.remove_boilerplate_lines(docs, least).columns == docs.columns


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    out = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), 256, with_ids=True).toPandas()
    want = collections.Counter()
    for r in fixture_rows():
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range((len(ids) - 1) % 256 + 1, len(ids), 256), len(ids)]
        want.update((r[0], i, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
    got = collections.Counter((None if d != d else int(d), p, s, n, c) for d, p, s, n, c in zip(out.doc_id, out.piece, out.start, out.length, out.ids_crc32))
    assert got == want
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.r_[0, g.length.cumsum()[:-1]].tolist() and g.length.sum() <= 256
    assert out.sequence_id.nunique() <= math.ceil(out.length.sum() / 256) + 2
    assert packing.pack_documents(empty, vocabulary("byte_bpe_50k.json")).count() == 0


def test_best_fit_with_few_open_bins():
    r = random.Random(2)
    sizes = [r.randrange(1, 65) for _ in range(500)]
    bins, offsets, loads = packing.best_fit(sizes, 64, 4)
    assert sum(loads) == sum(sizes) and max(loads) <= 64
    assert packing.best_fit([40, 30, 24, 34], 64, 2)[0] == [0, 1, 0, 1]


def test_lm_scoring(docs, empty):
    rows = fixture_rows()
    token = [[w.lower() for w in split(r[1])] + [b""] for r in rows]
    out_of = [zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 7 == 2 for r in rows]
    c = collections.Counter(t for ts, h in zip(token, out_of) if not h for t in ts)
    n, v = sum(c.values()), len(c)
    want = collections.Counter((r[0], h, len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), 6)) for r, h, t in zip(rows, out_of, token))
    got = lm_score.score_documents(docs).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert lm_score.score_documents(empty).count() == 0


def test_lm_scoring_rare_words_meet_exact_counts(docs, monkeypatch):
    whole = sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in lm_score.score_documents(docs).collect())
    monkeypatch.setattr(lm_score, "HEAD_ROWS", 3)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in lm_score.score_documents(docs).collect()) == whole


def test_log_frequency_filter_reads_what_was_put_in():
    f = lm_score.LogFrequencyFilter(1 << 18, 16)
    h = np.random.default_rng(5).integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
    n = np.random.default_rng(6).integers(1, 500, 3000)
    table = np.zeros(f.bits >> 3, dtype=np.uint8)
    for b in range(16):
        own = f.block_of(h) == b
        bits = f.fill(h[own], n[own])
        table[b * len(bits) : (b + 1) * len(bits)] = np.frombuffer(bits, dtype=np.uint8)
    read = f.read(table, h)
    assert (f.level(np.maximum(read, 1).astype(int)) >= f.level(n) - 1).all() and np.median(read / n) < 1.6
    absent = np.random.default_rng(7).integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
    assert (f.read(table, absent) == 0).mean() > 0.9
    for b in range(16):
        own = h[f.block_of(h) == b]
        assert np.array_equal(f.unpacked(f.packed(own), b), f.told_apart(own))


def test_sentencepiece(docs, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    want = []
    for r in fixture_rows():
        ids = library.encode(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    same(sentencepiece_codec.encode_documents(docs, vocabulary("piece_bpe_32k.model"), False).collect(), want)
    assert sentencepiece_codec.encode_documents(empty, vocabulary("piece_bpe_32k.model")).count() == 0


def test_sentencepiece_agenda_alone_equals_the_library():
    c = sentencepiece_codec.codec(vocabulary("piece_bpe_32k.model"))
    r = random.Random(8)
    for _ in range(500):
        text = "".join(r.choice("abeth  \n.,é0😀") for _ in range(r.randrange(1, 90)))
        ids = c.library.encode(text)
        assert [int(x) for x in c.encode([text])[0].split(b",")] == ids and c.decode(ids) == c.library.decode(ids)
        assert c.merge("▁" + text.replace(" ", "▁")) == ids
    assert c.differ == 0


def vectors(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=16)]) for i in range(600)]
    rows += [(600 + i, rows[40][1]) for i in range(60)] + [(700, None), (701, [float("nan")] * 16), (702, [None] + [1.0] * 15), (703, [0.0] * 16), (704, []), (None, rows[0][1]), rows[20], (720, [1.0, 2.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)), rows


def brute_search(rows, score, zero):
    from fractions import Fraction  # noqa: F401

    ok = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and (zero or any(v))}
    out = []
    for q in ok:
        if q % 20 == 0:
            found = sorted(((-score(ok[q], v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])))[:20]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(found)]
    return out


def test_exact_top_k(spark):
    df, rows = vectors(spark)
    want = brute_search(rows, lambda a, b: int(np.floor(64 * a) @ np.floor(64 * b)), True)
    same(segment_topk.exact_top_k(df).collect(), want)
    assert segment_topk.exact_top_k(df.limit(0)).count() == 0


def test_vantage_points_are_exact_at_factor_one(spark, monkeypatch):
    monkeypatch.setattr(vptree, "LEAF", 16)
    df, rows = vectors(spark)
    want = {(q, rank): (i, s) for q, rank, i, s in brute_search(rows, lambda a, b: round(float(a @ b), 9), False)}
    got = vptree.nearest(df, factor=1.0).collect()
    assert len(got) == len(want)
    assert all(abs(want[r.query_id, r["rank"]][1] - r.score) < 1e-6 for r in got)
    assert all(want[r.query_id, r["rank"]][0] == r.vec_id for r in got)
    assert vptree.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("values", [[], [0], [0, 1, 65536], [70000], [5, 65540, 65541], [65535, 131071, 2**19 - 1]])
def test_ascending_codes_round_trip(values):
    values = np.array(values, dtype=np.uint32)
    assert np.array_equal(unpack_ascending(pack_ascending(values)), values)


def test_toxicity_learns_and_orders(spark):
    r = random.Random(3)
    rude, rows, marks = ["scum", "idiot", "moron", "trash"], [], []
    for i in range(600):
        w = words(i, 40, 300)
        k = r.choice([0, 0, 0, 1, 2, 4])
        w += r.sample(rude, k)
        r.shuffle(w)
        rows.append((i, " ".join(w), k))
        if i < 400:
            marks.append((i, 1, int(k > 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score_toxicity(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).toPandas().sort_values("doc_id")
    k = np.array([x[2] for x in rows])
    assert (got.toxic.to_numpy()[400:] == (k[400:] > 0)).mean() > 0.95
    assert got.severity[k == 4].mean() > got.severity[k == 1].mean() > got.severity[k == 0].mean()


def test_toxicity_learns_stems_met_once_by_clean_texts(spark):
    r, ends, rows = random.Random(5), [f"{a}{b}" for a in "aeiou" for b in "lmnrst"], []
    for i in range(600):
        w = words(i, 40, 300)
        rude = i % 10 == 0
        w += ["bomen" + e for e in r.sample(ends, 3 if rude else int(r.random() < 0.3))]
        rows.append((i, " ".join(w), int(rude)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, truth int")
    marks = spark.createDataFrame([(i, 1, t) for i, _, t in rows[:400]], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, marks).toPandas().sort_values("doc_id")
    assert (got.toxic == (got.truth > 0)).all()


def test_toxicity_awkward_rows(docs, empty, labels):
    out = toxicity.score_toxicity(docs, labels)
    assert out.count() == len(fixture_rows()) and out.where("toxic").count() == 0
    assert toxicity.score_toxicity(empty, labels).count() == 0 and toxicity.score_toxicity(docs, labels.limit(0)).where("toxic").count() == 0
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_language_id(spark, docs, empty):
    r = random.Random(6)
    say = {"en": "the of and with that from this have".split(), "de": "und der nicht mit für sich eine auch".split(), "es": "los para una como pero sus más este".split()}
    rows = [(i, " ".join(r.choice(say[x]) for _ in range(r.randrange(4, 30))), x) for i, x in enumerate(r.choices(list(say), k=400))]
    out = langid.predict_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).toPandas()
    truth = {i: x for i, _, x in rows}
    aside = out[out.held_out]
    assert len(aside) > 50 and (aside.lang_pred == aside.doc_id.map(truth)).mean() > 0.97
    assert ((out.score >= 0) & (out.score <= 1)).all()
    got = langid.predict_language(docs).collect()
    assert len(got) == len(fixture_rows())
    texts = collections.Counter(t is None or not any(map(str.isalpha, t)) for _, t, *_ in fixture_rows())
    assert sum(r.lang_pred == "und" for r in got) == texts[True]
    assert langid.predict_language(empty).count() == 0
    assert {r.lang_pred for r in langid.predict_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_words_are_ascii_runs():
    from arborkit.llm.common import ascii_words

    text = "a b\x1cc\td\x0be\x0cf\rg\nh i"
    assert [w.decode() for w in ascii_words(text)] == re.findall(r"[^\x20\x09-\x0D]+", text)


def test_lm_scoring_holds_to_exact_counts_beyond_the_broadcast(spark, monkeypatch):
    r = random.Random(11)
    texts = [" ".join(f"w{int(r.paretovariate(0.6)) % 3000}" for _ in range(150)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(lm_score, "BROADCAST_BITS", 1 << 14)  # the filters are larger
    got = {x.doc_id: (x.held_out, x.score) for x in lm_score.score_documents(df).collect()}
    monkeypatch.setattr(lm_score, "BROADCAST_BITS", 1 << 29)
    assert {x.doc_id: x.score for x in lm_score.score_documents(df).collect()} == pytest.approx({i: s for i, (_, s) in got.items()})
    tokens = [[*t.split(), "\n"] for t in texts]
    one = collections.Counter(t for i, ts in enumerate(tokens) if not got[i][0] for t in ts)
    two = collections.Counter(p for i, ts in enumerate(tokens) if not got[i][0] for p in zip(["\n", *ts], ts))
    rest = sum(one.values()) + len(one) + 1
    assert 1 in two.values() and len(two) > 5000  # bigrams seen once are in the filter too

    def exact(ts):
        pairs = [two[p] for p in zip(["\n", *ts], ts)]
        return sum(math.log10(0.4 * min(1, n / max(1, one[a])) + 0.6 * (one[b] + 1) / rest) for n, a, b in zip(pairs, ["\n", *ts], ts))

    off = [(got[i][1] - exact(ts)) / len(ts) for i, ts in enumerate(tokens)]
    assert max(map(abs, off)) < 0.05 and abs(sum(off)) / len(off) < 0.03


def test_log_frequency_filter_stops_at_the_highest_level():
    f = lm_score.LogFrequencyFilter(1 << 14, 16, 9)
    assert (f.read_levels(np.full(f.bits >> 3, 255, dtype=np.uint8), np.arange(50, dtype=np.uint64), np.zeros(50, dtype=np.int64)) == 9).all()
