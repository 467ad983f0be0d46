"""The corpus pipeline against brute force, and the registered SQL of its operators."""

import collections
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from arborkit.llm import queries, toxicity

TABLES = "/root/testdata/sf0.001"


def split(text):
    return text.encode().split() if text else []


def brute_toxic(rows, spark):
    model = toxicity.train(spark.read.parquet(f"{TABLES}/documents.parquet"), spark.read.parquet(f"{TABLES}/labels.parquet"))
    judged = lambda t: model is not None and len(x := toxicity.features(t)) and model.above(np.array([model.weights[x].sum()]))[0, 0] >= 0.5
    return [r for r in rows if not judged(r["text"])]


def brute_lines(rows, least):
    sites = collections.defaultdict(set)
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if r["source"] is not None:
                sites[line.strip(" ")].add(r["source"])
    keep = lambda x: not x.strip(" ") or len(sites[x.strip(" ")]) < least
    return [r | {"text": None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if keep(x))} for r in rows]


def brute_near(rows, k, percent):
    sets = []
    for r in rows:
        w = [x.lower() for x in split(r["text"])]
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and up[i] != up[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up = [up[j] if x == up[i] else x for x in up]
    least = {}
    for r, u in zip(rows, up):
        least[u] = min(least.get(u, r["doc_id"]), r["doc_id"])
    return [r for r, u, s in zip(rows, up, sets) if not s or least[u] == r["doc_id"]]


def brute_windows(rows, k):
    count = collections.Counter(tuple(w[i : i + k]) for w in (split(r["text"]) for r in rows) for i in range(len(w) - k + 1))
    out = []
    for r in rows:
        w = split(r["text"])
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if count[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        out.append(r | {"text": b" ".join(x for x, g in zip(w, gone) if not g).decode()} if any(gone) else r)
    return out


def brute_pieces(rows, length=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    out = collections.Counter()
    for r in rows:
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range((len(ids) - 1) % length + 1, len(ids), length), len(ids)]
        out.update((r["doc_id"], i, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
    return out


def told(rows):
    return collections.Counter((r["doc_id"], r["text"], r["lang"], r["source"], None if r["text"] is None else len(r["text"])) for r in rows)


def test_every_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    brute = [
        lambda x: brute_toxic(x, spark), lambda x: brute_lines(x, queries.MIN_SITES),
        lambda x: brute_near(x, corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT), lambda x: brute_windows(x, corpus_pipeline.WINDOW),
    ]
    changed = 0
    for (name, stage), f in zip(corpus_pipeline.STAGES, brute):
        docs = corpus_pipeline.materialize(stage(spark, docs, TABLES), "test-stage")
        before, rows = rows, f(rows)
        changed += told(before) != told(rows)
        got = [r.asDict() for r in docs.collect()]
        assert list(got[0]) == list(before[0]), name
        assert told(got) == told(rows), name
        if name != "toxicity":
            assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)
    assert changed >= 3
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, TABLES).toPandas()
    assert collections.Counter(zip(placed.doc_id, placed.piece, placed.start, placed.length, placed.ids_crc32)) == brute_pieces(rows)
    for _, g in placed.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.r_[0, g.length.cumsum()[:-1]].tolist() and g.length.sum() <= 2048
    assert placed.sequence_id.nunique() <= 1.01 * placed.length.sum() / 2048 + 2
    whole = corpus_pipeline.run(spark, TABLES).toPandas()
    assert sorted(zip(whole.doc_id, whole.piece, whole.length)) == sorted(zip(placed.doc_id, placed.piece, placed.length))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_counterparts(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{TABLES}/{t}.parquet'")
    got = queries.queries()[name](spark, TABLES).toPandas()
    want = con.sql(queries.oracle_sql()[name]).df()[list(got.columns)]
    order = list(got.columns)[:3]
    assert got.sort_values(order).astype(str).to_numpy().tolist() == want.sort_values(order).astype(str).to_numpy().tolist()


def test_tables_can_be_cleared(spark):
    from arborkit.llm import common

    table = common.materialize(spark.range(5), "to-clear")
    assert table.count() == 5
    path = spark._jvm.org.apache.hadoop.fs.Path(table._shared_path)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert files.exists(path)
    common.clear_tables(spark)
    assert not files.exists(path)
    assert common.materialize(spark.range(3), "again").count() == 3
