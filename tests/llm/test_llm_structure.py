"""Conversation repair, SimHash near-dedup and phrase mining against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from arborkit.llm import collocations, conversation, simhash

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


# ---------------------------------------------------------------- conversation repair
def all_edits(rows):
    """Every useful sequence of edits (up to two insertions at a place): cost, audit, repaired lines."""
    ins = ["", "I", "II"]
    for steps in itertools.product(itertools.product(ins, "KRD"), repeat=len(rows)):
        for end in ins:
            yield "".join(a + b for a, b in steps) + end


def follow(rows, audit):
    """Cost and repaired lines of an audit, or None where no roles fit it."""
    cost, lines, initials, at = 0, [], "", 0
    n = len(audit) - audit.count("D")
    for edit in audit:
        if edit == "I":
            cost, part = cost + 2, (None, "")
        else:
            role, text, fault = rows[at]
            at += 1
            if edit == "D":
                cost += 3
                continue
            if fault in ("blank", "duplicate"):
                return None
            cost += fault == "truncated"
            part = (role, text) if edit == "K" else (None, text)
            cost += 2 * (edit == "R")
        lines.append(part)
    led = bool(lines) and lines[0][0] is not None and lines[0][0][:1] == "s"
    if n and (n - led < 2 or (n - led) % 2):
        return None
    out = []
    for i, (role, text) in enumerate(lines):
        want = "s" if led and i == 0 else "ua"[(i - led) % 2]
        if role is None:
            if want == "s":
                return None
            role = {"u": "user", "a": "assistant"}[want]
        elif role[:1] != want:
            return None
        out.append(f"{role}:{text}")
    return cost, "\n".join(out)


def brute_repair(rows):
    """Result of rows ``(turn, role, text)`` of one conversation, nulls replaced."""
    def digest(r):
        return hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()

    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
    seen, faults = set(), []
    for _, role, text in rows:
        core = text.strip(BLANKS)
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    judged = [(r[1], r[2], f) for r, f in zip(rows, faults)]
    best = min((found[0], audit, found[1]) for audit in all_edits(judged) if (found := follow(judged, audit)))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest()


def harmed(conv, turn, role, text):
    conv_key, turn_key, role, text = (" " if x is None else x for x in (conv, turn, role, text))
    harm = zlib.crc32(f"{conv_key}:{turn_key}".encode()) % 20
    text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
    return [(turn, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)


def told(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(3)


def some_conversations(seed, n, most):
    r = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(r.randrange(most)):
            turn = None if r.random() < 0.05 else turn + r.randrange(2)
            rows.append((conv, turn, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice(["A.", "B", "what?", "  ", None, "", "C! ", "é. ", "a\nb.\x0b"])))
    return rows


def as_tuples(df, first):
    names = [c for c in df.columns if c != first]
    return {r[first]: tuple(r[c] for c in names) for r in df.collect()}


def test_conversation_repair_equals_brute_force(spark):
    rows = some_conversations(1, 150, 5)
    got = as_tuples(conversation.repair_conversations(told(spark, rows)), "conv_id")
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    assert got == {conv: brute_repair(own) for conv, own in by.items()}


def test_conversation_query_equals_brute_force(spark):
    rows = some_conversations(2, 200, 5) + [(900 + i, 0, "user", "Gone or not.") for i in range(60)]
    rows += rows[-3:]
    table = told(spark, rows)
    got = as_tuples(conversation.repair_conversations(table, conversation.damaged(table)), "conv_id")
    by = {r[0]: [] for r in rows}
    for r in rows:
        by[r[0]] += harmed(*r)
    assert any(not x for x in by.values())
    assert got == {conv: brute_repair(own) for conv, own in by.items()}


def test_conversation_without_rows_and_empty_table(spark):
    empty = told(spark, [])
    assert conversation.repair_conversations(empty, conversation.damaged(empty)).collect() == []
    lone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table = told(spark, [(lone, 0, "user", "Hi.")])
    (row,) = conversation.repair_conversations(table, conversation.damaged(table)).collect()
    assert tuple(row) == (lone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_one_long_conversation_is_cut_into_pieces(spark):
    """Its signature comes from several partitions; turns that meet at an edge count once."""
    rows = [(7, i // 3, ["user", "assistant"][i % 2], f"text {i} " + "x" * (i % 50) + ".") for i in range(6000)] + [(8, 5, "user", "Hi.")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = conversation.signatures_of(told(spark, rows).select("conv_id", "turn", "role", "text"))
        got = {r["conv_id"]: r for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got[7]["sig"]) == 6000 and got[7]["gaps"] == 0 and got[8]["gaps"] == 0
    assert got[7]["sig"].count(conversation.letter(1, conversation.OK)) == 3000


def test_prefix_trie_shares_layers():
    r = random.Random(5)
    signatures = sorted({"".join(conversation.letter(r.randrange(4), r.randrange(4)) for _ in range(r.randrange(1, 7))) for _ in range(800)})
    trie, whole, nodes = conversation.PrefixTrie(), 0, set()
    for signature in signatures:
        trie.insert(signature)
        alone = conversation.PrefixTrie()
        alone.insert(signature)
        assert trie.answer() == alone.answer()
        whole += len(signature)
        nodes |= {signature[: i + 1] for i in range(len(signature))}
    assert trie.computed == len(nodes) < whole


def test_a_long_signature_needs_little():
    trie = conversation.PrefixTrie()
    trie.insert(conversation.letter(1, 0) * 20_000)
    cost, audit = trie.answer()
    assert len(audit) >= 20_000 and cost == 20_000  # every second row becomes the assistant's


# ---------------------------------------------------------------------- SimHash links
def brute_print(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def brute_components(prints, most):
    """Root of each of some distinct fingerprints."""
    up = {p: p for p in prints}

    def find(p):
        while up[p] != p:
            p = up[p]
        return p

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= most:
            up[find(a)] = find(b)
    return {p: find(p) for p in prints}


def near_texts():
    r = random.Random(3)
    base = [[f"w{r.randrange(60)}" for _ in range(n)] for n in (300, 120, 80)]
    texts = [None, "", " \t ", "One", "one two", "a b c", "a b c d", "a b c d e f", "é ü x\x1cy 😀 ﬁ", "z " * 700, " ".join(f"v{i}" for i in range(5000))]
    for words in base:
        for _ in range(25):
            copy = list(words)
            for _ in range(r.randrange(3)):
                copy[r.randrange(len(copy))] = f"w{r.randrange(60)}"
            texts.append(" ".join(copy).upper() if r.random() < 0.2 else " ".join(copy))
    return texts


@pytest.mark.parametrize(("k", "most"), [(4, 4), (5, 3), (2, 0)])
def test_simhash_components(spark, k, most):
    rows = [(i, t, "f") for i, t in enumerate(near_texts())]
    rows += [rows[12], (None, "a b c d", "f"), (None, "quite alone here now", "f"), (None, None, "f")]
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(3), k, most).collect()
    prints = [brute_print(t, k) for _, t, _ in rows]
    roots = brute_components(sorted(set(prints)), most)
    least = {}
    for (doc, _, _), p in zip(rows, prints):
        if doc is not None:
            least[roots[p]] = min(doc, least.get(roots[p], doc))
    want = collections.Counter((doc, f"{p:016x}", least.get(roots[p])) for (doc, _, _), p in zip(rows, prints))
    assert collections.Counter(map(tuple, got)) == want
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string"), k, most).collect() == []


def test_simhash_counts_in_small_lots(monkeypatch):
    texts = near_texts()
    whole = simhash.fingerprints(texts, 4).tolist()
    monkeypatch.setattr(simhash, "HELD", 500)
    assert simhash.fingerprints(texts, 4).tolist() == whole == [brute_print(t, 4) for t in texts]


def clustered(seed, n):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2**63, size=6, dtype=np.uint64)[rng.integers(0, 6, n)] * np.uint64(2)
    for _ in range(4):
        x = x ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(x)


@pytest.mark.parametrize("seed", range(8))
def test_tries_find_all_links(seed):
    lots = [clustered(seed, 150), clustered(seed + 100, 1), clustered(seed + 200, 90)]
    ends = np.cumsum([len(x) for x in lots])
    prints = np.concatenate(lots)
    got = simhash.Forest(prints, np.r_[0, ends[:-1]], ends).components(4).roots()
    for lo, hi in zip(np.r_[0, ends[:-1]], ends):
        want = brute_components([int(p) for p in prints[lo:hi]], 4)
        groups = collections.defaultdict(set)
        for root, p in zip(got[lo:hi], prints[lo:hi]):
            groups[root].add(want[int(p)])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_tries_prune_node_pairs():
    prints = np.unique(np.random.default_rng(0).integers(0, 2**63, size=4000, dtype=np.uint64))
    forest = simhash.Forest(prints, [0], [len(prints)])
    forest.components(1)
    assert forest.met < len(prints) ** 2 / 20


@pytest.mark.parametrize("classes", [10, 10**8, 10**11, 10**14])
def test_keys_lose_no_pair(classes):
    masks = simhash.keys_for(classes, 4)
    r = random.Random(classes)
    for _ in range(3000):
        differ = sum(1 << b for b in r.sample(range(64), 4))
        assert any(differ & m == 0 for m in masks)


def test_simhash_joins_large_groups_in_blocks(spark, monkeypatch):
    prints = clustered(11, 400)
    table = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    whole = simhash.links(table, 4).collect()
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "LOT", 100)
    cut = simhash.links(table, 4).collect()
    want = brute_components([int(p) for p in prints], 4)
    for edges in (whole, cut):
        up = brute_components([], 0) | {int(p): int(p) for p in prints}

        def find(p):
            while up[p] != p:
                p = up[p]
            return p

        for a, b in edges:
            a, b = a % 2**64, b % 2**64
            assert want[a] == want[b]
            up[find(a)] = find(b)
        assert len({find(int(p)) for p in prints}) == len(set(want.values()))


# -------------------------------------------------------------------- phrase mining
def brute_phrases(rows, least, longest, percent, top):
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = collections.defaultdict(int)
        for q, b in candidates.items():
            for size in range(2, len(q)):
                for i in range(len(q) - size + 1):
                    inside[q[i : i + size]] = max(inside[q[i : i + size]], b)
        best = []
        for p, a in candidates.items():
            if p in inside and 100 * inside[p] >= percent * a:
                continue
            score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def phrase_rows(seed=1, n=300):
    r = random.Random(seed)
    passage = "the Quick brown fox jumps over it"
    rows = [(None, None), ("en", ""), ("en", " .,;\n\t"), (None, "go go go go go go. go go!"), ("en", "é\x1cü x\x85y é\x1cü x\x85y"), ("en", "\x00 nul \x00 nul")]
    for _ in range(n):
        words = [r.choice(["alpha", "Beta", "gamma", "ß", "delta", f"rare{r.randrange(500)}"]) for _ in range(r.randrange(40))]
        if r.random() < 0.5:
            words.insert(r.randrange(len(words) + 1), passage)
        rows.append((r.choice(["en", "de", "de", None]), "".join(w + r.choice([" ", " ", "\t ", ". ", ",", "\n", "  "]) for w in words)))
    return rows + rows[-5:]


@pytest.mark.parametrize(("least", "longest", "percent", "top"), [(5, 5, 100, 2000), (3, 3, 80, 7), (40, 2, 100, 2000)])
def test_collocations_equal_brute_force(spark, monkeypatch, least, longest, percent, top):
    rows = phrase_rows()
    table = spark.createDataFrame([(*x, 1) for x in rows], "lang string, text string, score int").repartition(3)
    want = sorted(brute_phrases(rows, least, longest, percent, top))
    assert want and sorted(map(tuple, collocations.collocations(table, least, longest, percent, top).collect())) == want
    monkeypatch.setattr(collocations, "SHARD", 60)
    monkeypatch.setattr(collocations, "ROOTS", 9)
    monkeypatch.setattr(collocations, "PART", 20)
    monkeypatch.setattr(collocations, "HELD", 50)
    assert sorted(map(tuple, collocations.collocations(table, least, longest, percent, top).collect())) == want


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert collocations.collocations(spark.createDataFrame([("en", None), (None, "a b")], "lang string, text string")).collect() == []


def test_scores_beyond_64_bits_are_exact(spark):
    """A phrase of 100,000 places among 400,000 words: 1000 a n passes 2 ** 45 here, its decimals are those of 38 digits."""
    table = spark.createDataFrame([("en", "x y. " * 1000 + "z " * 2000)] * 100, "lang string, text string")
    got = {r["phrase"]: r for r in collocations.collocations(table, 100).collect()}
    row = got["x y"]
    assert (row["a"], row["l"], row["r"], row["n"]) == (100_000, 100_000, 100_000, 400_000)
    assert row["score"] == 1000 * 100_000 * 400_000 // 100_000**2
    expr = "(cast(1000 as decimal(38,0)) * (cast(9000000000001 as decimal(19,0)) * cast(9000000000003 as decimal(19,0)))) div (cast(7000000001 as decimal(19,0)) * cast(9000000007 as decimal(19,0)))"
    assert spark.sql(f"select {expr}").first()[0] == 1000 * 9000000000001 * 9000000000003 // (7000000001 * 9000000007)


def test_bitmaps_shift_over_block_edges():
    ids = np.array([1, 2] * 200 + [0, 1, 1, 0], dtype=np.int32)
    shard = collocations.Shard()
    shard.ids, shard.words = ids, [b"\xff", b"a", b"b"]
    own = np.array([3, 5, 9], dtype=np.uint64)
    found = {name: int(t) for _, names, times in collocations.mined(shard, own, np.array([False, True, True]), range(2, 5)) for name, t in zip(names.to_pylist(), times)}
    assert found == {"a b": 200, "b a": 199, "a a": 1, "a b a": 199, "b a b": 199, "a b a b": 199, "b a b a": 198}


def test_count_sketch_never_falls_short(spark, monkeypatch):
    r = np.random.default_rng(7)
    monkeypatch.setattr(collocations.CountSketch, "block_bits", 8)
    keys, times = r.integers(0, 2**63, size=3000, dtype=np.uint64), r.integers(1, 400, size=(4, 3000))
    sketch = collocations.CountSketch(2**17 * 300 / 32, 300)
    parts = [sketch.emit_counts(keys, t) for t in times]
    rows = [(b, bytes(p)) for part in parts for b, p in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
    table = sketch.merge(spark.createDataFrame(rows, "block long, part binary"))
    told, total = sketch.repeated(table, keys), times.sum(axis=0)
    assert told[total >= 300].all() and not told[total < 300].all()


def test_shards_come_back_as_packed():
    shard = collocations.Shard()
    for part in collocations.tokens("A b, a c. d!"):
        shard.add(part)
    again = collocations.Shard.opened(*shard.packed())
    assert [again.words[i] for i in again.ids] == [b"a", b"b", b"\xff", b"a", b"c", b"\xff", b"d", b"\xff", b"\xff"]


def test_queries_are_registered():
    from arborkit.llm import queries

    assert {"op11_conversation_repair", "op12_simhash_dedup", "op13_phrase_collocations"} <= set(queries.queries())
