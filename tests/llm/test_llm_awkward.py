"""Operators and stages on long texts, clashing names, repeated ids, ties and skew."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arborkit.llm import common, langid, line_dedup, lm_score, ngram_join, packing, segment_topk, sentencepiece_codec, substring_dedup, toxicity, vectors, vptree
from arborkit.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
TABLES = "/root/testdata"


def long_texts():
    r = random.Random(1)
    return [
        " " * 1_000_000 + "x", "\n" * 1_000_000 + "x", "\t" * 300_000 + "x", " \n" * 200_000, "x" * 1_000_000, "".join(r.choice("abcdefgh") for _ in range(300_000)),
        " ".join(f"w{r.randrange(10**6)}" for _ in range(200_000)), "line\n" * 200_000, "漢字" * 50_000, None, "", "short and plain",
    ]


@pytest.fixture(scope="module")
def long_docs(spark):
    return spark.createDataFrame([(i, t, "en", f"s{i}", 1) for i, t in enumerate(long_texts())], SCHEMA).repartition(3)


def test_packing_encodes_long_texts_whole(long_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary(BPE))
    got = packing.pack_documents(long_docs, vocabulary(BPE)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(long_texts())}


def test_long_white_space_is_counted_as_encoded_by_the_library():
    e = packing.ByteBpe(vocabulary(BPE))
    e.encode(["plain text", " " * 5000 + "x", "a b"])
    assert e.by_library == 2  # the first text is the check of its batch


def test_sentencepiece_encodes_long_texts_whole(long_docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
    want = {i: hashlib.sha256(",".join(map(str, library.encode(t or ""))).encode()).hexdigest() for i, t in enumerate(long_texts())}
    assert {r.doc_id: r.ids_sha256 for r in sentencepiece_codec.encode_documents(long_docs, vocabulary(PIECES), False).collect()} == want


def test_long_texts_through_line_and_window_dedup(long_docs):
    lines = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.judge_lines(long_docs, 5).collect()}
    assert lines == {i: (len(t.split("\n")) if t is not None else 0, 0) for i, t in enumerate(long_texts())}
    words = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.judge_windows(long_docs).collect()}
    assert words[7] == (200_000, 200_000) and words[4] == (1, 0) and words[6] == (200_000, 0) and words[0] == (1, 0) and words[3] == (0, 0)


def test_long_texts_through_the_other_operators(spark, long_docs):
    n = len(long_texts())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_components(long_docs).collect()}
    assert got[0] == got[1] == got[2] == (1, 0) and got[6][0] == 200_000 - 4 and got[4] == (1, 4) and got[3] == (0, 3)
    marks = spark.createDataFrame([(6, 1, 0), (11, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(long_docs, marks).count() == n
    assert {r.doc_id: r.lang_pred for r in langid.predict_language(long_docs).collect()}[3] == "und"
    assert {r.doc_id: r.n_tokens for r in lm_score.score_documents(long_docs).collect()} == {i: len((t or "").encode().split()) + 1 for i, t in enumerate(long_texts())}


def test_every_script_goes_through_the_agenda():
    c = sentencepiece_codec.MergeCodec(vocabulary(PIECES))
    texts = ["这是 一个 测试。", "هذا اختبار عربي", "यह एक परीक्षण है", "smile 😀 now", "price 5 € ok", "ﬁne ligature", "café decomposed", "한국어 문장", "เฉพาะ"]
    assert [[int(x) for x in y.split(b",")] for y in c.encode(texts)] == [c.library.encode(t) for t in texts]
    assert c.by_library == 0 and c.differ == 0
    c.encode(["▁ by hand", "nul \x00 here"])
    assert c.by_library == 2


NAMES = ["__key", "__text", "__gone", "__lines", "__stay", "__row", "__row_key", "__windows", "f0", "none", "row_key", "window", "site", "line", "pos", "h1", "cls", "component", "gone", "severity", "grp", "piece", "load", "sequence"]


def clashing(spark):
    rows = [(i, f"head {i}\nshared line\n" + " ".join(f"t{i}w{j}" for j in range(50)), "en", f"s{i % 5}", None) for i in range(12)]
    docs = spark.createDataFrame(rows + [(3, None, None, None, None), (None, "", None, None, None), rows[1]], SCHEMA)
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(NAMES)])


def test_clashing_names_pass_through_operators(spark):
    docs = clashing(spark)
    for out, removed in ((line_dedup.judge_lines(docs, 3), 1), (substring_dedup.judge_windows(docs, 35), 0)):
        assert set(docs.columns) < set(out.columns)
        row = out.where("doc_id = 5").first()
        assert [row[c] for c in NAMES] == list(range(len(NAMES))) and row.n_removed == removed
    old = docs.withColumn("n_removed", F.lit(-1)).withColumn("n_lines", F.lit(-1))
    row = line_dedup.judge_lines(old, 3).where("doc_id = 5").first()
    assert (row.n_lines, row.n_removed) == (3, 1)


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stage_on_awkward_rows(spark, tmp_path, number):
    name, stage = corpus_pipeline.STAGES[number]
    spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 1, 0), (4, 0, 0), (None, None, None), (1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = clashing(spark)
    out = stage(spark, docs, str(tmp_path))
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    if number + 1 < len(corpus_pipeline.STAGES):
        assert out.columns == docs.columns
        assert [out.where("doc_id = 5").first()[c] for c in NAMES] == list(range(len(NAMES)))
    ids = collections.Counter(r.doc_id for r in out.select("doc_id").collect())
    assert ids[None] == 1 and set(range(12)) <= set(ids)


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stage_takes_long_texts(spark, long_docs, tmp_path, number):
    spark.createDataFrame([(6, 1, 0), (11, 1, 1), (10, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.STAGES[number][1](spark, long_docs, str(tmp_path))
    assert out.where("doc_id = 6").count() >= 1


def test_training_samples_are_bounded_in_rows(spark, monkeypatch):
    rows = [(7, f"word{i} text", "en", "s", 1) for i in range(400)] + [(i, f"other{i} words", "de", "s", 1) for i in range(100, 140)]
    docs = spark.createDataFrame(rows, SCHEMA)
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda found, grades: seen.setdefault("toxicity", len(found)) and None)
    toxicity.train(docs, spark.createDataFrame([(i, 1, i % 2) for i in [7, *range(100, 140)]], "doc_id long, quality int, toxic int"))
    monkeypatch.setattr(langid, "fit", lambda sample, y, languages: seen.setdefault("language", len(sample)) and None)
    langid.train(docs, 4, 2)
    assert seen["toxicity"] == 41 and 1 < seen["language"] <= 41


def test_predictions_equal_the_models_own(spark):
    """Every row's result against one computed text by text from the fitted model."""
    docs = spark.read.parquet(f"{TABLES}/sf0.001/documents.parquet")
    model = langid.train(docs.select("doc_id", "text", "lang"), 4, 2)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in langid.predict_language(docs).collect():
        buckets = langid.subwords(langid.words_of(texts[r.doc_id]))[0]
        if not langid.has_letter(texts[r.doc_id]):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        p = model.probabilities(model.scores[buckets].astype(float).sum(axis=0, keepdims=True) / max(1, len(buckets)))[0]
        assert r.lang_pred == model.languages[int(p.argmax())] and abs(p.max() - r.score) < 1e-5
    labels = spark.read.parquet(f"{TABLES}/sf0.001/labels.parquet")
    ordinal = toxicity.train(docs, labels)
    for r in toxicity.score_toxicity(docs, labels).collect():
        x = toxicity.features(r.text)
        up = ordinal.above(np.array([ordinal.weights[x].sum()]))[0] if ordinal and len(x) else np.zeros(2)
        assert abs(r.severity - up.sum()) < 1e-6 and abs(r.p_toxic - up[0]) < 1e-6 and r.toxic == (up[0] >= 0.5)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{TABLES}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = langid.predict_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count() > 100
    marks = labels.where("toxic is not null")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    judged = toxicity.score_toxicity(docs, marks.where(~fold)).select("doc_id", F.col("toxic").alias("found")).join(marks.where(fold), "doc_id")
    clean = judged.where("toxic = 0")
    assert clean.where("found").count() <= 0.02 * clean.count()


def test_toxicity_recall_on_held_out_rows(spark):
    """Most toxic rows that the fit never saw are found, and few clean ones."""
    docs, marks = (spark.read.parquet(f"{TABLES}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    asked = docs.join(marks.where(fold).select("doc_id"), "doc_id", "left_semi").unionByName(docs.join(marks.where(~fold).select("doc_id"), "doc_id", "left_semi"))
    judged = toxicity.score_toxicity(asked, marks.where(~fold)).select("doc_id", F.col("toxic").alias("found")).join(marks.where(fold), "doc_id")
    told = {r.toxic: r for r in judged.groupBy("toxic").agg(F.count_if("found").alias("found"), F.count("*").alias("n")).collect()}
    assert told[1].n > 50 and told[1].found >= 0.8 * told[1].n
    assert told[0].found <= 0.01 * told[0].n


def exact_nearest(x, q, k):
    """Ids by exact inner product as the operator sums it, ties to smaller ids."""
    s = np.array([vectors.dot(np.repeat(x[i : i + 1], len(x), axis=0), x) for i in q])
    s[np.arange(len(q)), q] = -np.inf
    return [np.lexsort((np.arange(len(x)), -row))[:k].tolist() for row in s]


def test_vantage_points_with_many_copies_at_the_largest_norm(spark, monkeypatch):
    monkeypatch.setattr(vptree, "LEAF", 8)
    monkeypatch.setattr(vectors, "SAMPLE", 64)
    for seed in range(3):
        r = np.random.default_rng(seed)
        x = r.normal(size=(300, 12))
        x[r.choice(300, 100, replace=False)] = 3 * x[np.argmax((x**2).sum(axis=1))]
        got = collections.defaultdict(list)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        for row in vptree.nearest(df, factor=1.0).orderBy("query_id", "rank").collect():
            got[row.query_id].append(row.vec_id)
        assert list(got.values()) == exact_nearest(x, list(range(0, 300, 20)), 20)


def test_recall_at_the_registered_factor(spark):
    df = spark.read.parquet(f"{TABLES}/sf0.1/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], dtype=np.float32).astype(float)
    ids = np.array([r.vec_id for r in rows])
    q = np.flatnonzero(ids % 20 == 0)
    want = {int(ids[i]): set(ids[found].tolist()) for i, found in zip(q, exact_nearest(x, q, 20))}
    got = collections.defaultdict(set)
    for r in vptree.nearest(df).collect():
        got[r.query_id].add(r.vec_id)
    assert set(got) == set(want) and all(len(found) == 20 for found in got.values())
    assert sum(len(got[i] & want[i]) for i in want) >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("factor", [0.0, 0.22, 1.0])
def test_every_query_has_all_its_results(spark, monkeypatch, factor):
    """Whatever is pruned, each query gets k rows, or all candidates of its dimension if there are fewer."""
    monkeypatch.setattr(vectors, "SAMPLE", 40)
    monkeypatch.setattr(vptree, "SHARD_BYTES", 4096)
    x = np.random.default_rng(8).normal(size=(400, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, [1.0, float(i)]) for i in range(1000, 1006)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in vptree.nearest(df, k=20, factor=factor).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {*range(0, 400, 20), 1000}
    for q, found in got.items():
        due = 5 if q == 1000 else 20
        assert [f[0] for f in found] == list(range(1, due + 1)) and len({f[1] for f in found}) == due and q not in {f[1] for f in found}
        assert [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)


def test_trees_leave_rows_without_a_distance():
    x = np.random.default_rng(1).normal(size=(3000, 32))
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    order, *tree = vptree.build(vptree.lifted(x, 1.0))
    search = vptree.TreeSearch(vptree.lifted(x[order], 1.0), *tree, 20, vptree.FACTOR)
    search.run(np.c_[x[:50], np.zeros(50)], np.full(50, -1), np.full(50, np.inf))
    assert search.measured < 0.8 * 50 * 3000


@pytest.mark.parametrize("spread", [0.0, 1e-13, 1e-3])
def test_rows_at_one_distance_from_a_vantage_point(monkeypatch, spread):
    monkeypatch.setattr(vptree, "LEAF", 8)
    r = np.random.default_rng(2)
    x = np.array([1.0, 0, 0, 0]) + spread * r.normal(size=(60, 4))
    order, *tree = vptree.build(vptree.lifted(x, 1.2))
    q = r.normal(size=(5, 4))
    search = vptree.TreeSearch(vptree.lifted(x[order], 1.2), *tree, 20, 1.0)
    at, to = search.run(np.c_[q, np.zeros(5)], np.full(5, -1), np.full(5, np.inf))
    score = q @ x[order].T
    for i in range(5):
        found = np.sort(score[i, to[at == i]])[::-1][:20]
        assert np.allclose(found, np.sort(score[i])[::-1][:20], rtol=0, atol=1e-15)


def test_shards_and_query_blocks_may_be_many(spark, monkeypatch):
    for name, size in (("SHARD_BYTES", 4096), ("BLOCK_BYTES", 1024)):
        for module in (vptree, segment_topk):
            monkeypatch.setattr(module, name, size)
    monkeypatch.setattr(vectors, "GROUP_SHARDS", 2)
    x = np.random.default_rng(4).normal(size=(700, 16)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = list(range(0, 700, 20))
    got = collections.defaultdict(list)
    for r in vptree.nearest(df, factor=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert list(got.values()) == exact_nearest(x, q, 20)
    got = collections.defaultdict(list)
    for r in segment_topk.exact_top_k(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert list(got.values()) == exact_nearest(np.floor(64 * x), q, 20)


def test_top_k_scores_beyond_a_long_are_held_at_its_ends(spark):
    x = np.random.default_rng(5).normal(size=(100, 16)) * 3e8
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = segment_topk.exact_top_k(df, k=5).collect()
    whole = [[int(c) for c in np.floor(64 * v)] for v in x]
    held = lambda a, b: max(-(2**63), min(2**63 - 1, sum(p * q for p, q in zip(a, b))))
    want = {(q, rank + 1): (i, -s) for q in range(0, 100, 20) for rank, (s, i) in enumerate(sorted((-held(whole[q], v), i) for i, v in enumerate(whole) if i != q)[:5])}
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == want


def test_segment_levels_drop_pairs():
    x = np.floor(64 * np.random.default_rng(6).normal(size=(2000, 64)) / 8)
    search = segment_topk.SegmentSearch(x, 20)
    floor = np.sort(x[:40] @ x.T, axis=1)[:, -21]
    search.run(x[:40], floor, np.arange(40))
    assert search.left[-1] < 0.7 * search.pairs


def test_the_fullest_bin_closes_inside_pack(spark):
    r = random.Random(3)
    sizes = [r.randrange(1, 40) for _ in range(600)]
    rows = [(i, 0, 0, n, i) for i, n in enumerate(sizes)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    few, many = (packing.pack(pieces, 64, 4096, bins).toPandas() for bins in (4, 4096))
    for out in (few, many):
        assert len(out) == 600 and sorted(out.length) == sorted(sizes)
        for _, g in out.sort_values("offset").groupby("sequence_id"):
            assert g.offset.tolist() == np.r_[0, g.length.cumsum()[:-1]].tolist() and g.length.sum() <= 64
    assert few.sequence_id.nunique() > many.sequence_id.nunique() >= math.ceil(sum(sizes) / 64)


def test_packing_closes_bins_at_its_own_settings():
    """At production settings a group's longer half opens more bins than may stay open."""
    r = random.Random(4)
    sizes = sorted((r.randrange(1, 2049) for _ in range(packing.GROUP)), reverse=True)
    opened = len(packing.best_fit(sizes, 2048, packing.OPEN_BINS)[2])
    assert opened != len(packing.best_fit(sizes, 2048, packing.GROUP)[2])
    assert opened <= 1.1 * sum(sizes) / 2048


def test_equal_pieces_spread_over_groups(spark):
    pieces = spark.createDataFrame([(None, 0, 0, 500, 1)] * 900, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(3)
    out = packing.pack(pieces, 2048, 100)
    assert out.count() == 900 and out.groupBy("sequence_id").count().count() <= 240


def test_components_join_plain_shuffles(spark, monkeypatch):
    """The minima are read from a table where they meet the edges: no aggregate in the join's stage."""
    plans = []
    real = common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, tag: plans.append((tag, df._jdf.queryExecution().optimizedPlan().toString())) or real(df, tag))
    edges = spark.createDataFrame([(0, i) for i in range(1, 500)] + [(i, i + 1) for i in range(600, 640)], "a long, b long")
    assert {r.component for r in common.connected_components(edges).collect()} == {0, 600}
    for tag, plan in plans:
        if "Join" in plan:
            below = plan[plan.index("Join") :]
            assert "Aggregate" not in below, tag


def test_a_passage_that_is_everywhere(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"a{i} b{i} {passage} c{i}") for i in range(300)]
    got = substring_dedup.judge_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all((r.n_words, r.n_removed) == (63, 60) for r in got)


def test_no_shared_folder_on_a_cluster_is_an_error(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        common.shared_folder(Session())


def test_parts_of_a_block_are_added_up_as_they_pass(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "HELD_PARTS", 50)
    r = np.random.default_rng(9)
    sized = lm_score.LogFrequencyFilter(1 << 20, 16)
    want, rows = collections.Counter(), []
    for _ in range(30):
        h = np.unique(sized.told_apart(common.mix64(r.integers(0, 500, size=80).astype(np.uint64))))
        n = r.integers(1, 9, size=len(h))
        want.update(dict(zip(h.tolist(), n.tolist())))
        part = sized.parts(h, n)
        rows += [(b, bytes(x), bytes(y)) for b, x, y in zip(*(c.to_pylist() for c in part.columns))]
    found = {}
    for row in sized.counted(spark.createDataFrame(rows, lm_score.PARTS).repartition(5), "test").collect():
        levels = np.frombuffer(bytes(row.levels), dtype=np.uint8)
        assert row.put == levels.sum() and row.top == levels.max()
        found.update(zip(sized.unpacked(bytes(row.hashes), row.block).tolist(), levels.tolist()))
    assert found == {h: int(sized.level(np.array([n]))[0]) for h, n in want.items()}
