import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from strandlog.llm import components, embedding_dedup, exact_dedup, minhash_dedup, shingles, suffix_dedup

#: Columns that a table may have besides, with names the operators use inside.
EXTRA = "doc_id long, text string, _id long, _text string, _digest string, ids binary, kept boolean, component_id long, w int, _d binary, label int"


def frame(spark, docs, parts=3):
    return spark.createDataFrame([(i, t, -1, "x", "y", None, None, None, 1, None, 0) for i, t in docs], EXTRA).repartition(parts)


def sentence(rng, n, words=200):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    docs = []
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(60)]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(60)] = f"x{rng.randrange(9999)}"
            docs.append(" ".join(w))
    docs += [docs[0], docs[0].upper(), docs[0].replace(" ", "\t\n "), "", None, "one two", "one two", "one\ttwo", "ONE two", " ", "é ß é ß é", "a b c d e f"]
    docs += ["lone " * 3000, "lone " * 3000, "very long " * 60_000, "very  long\t" * 60_000]
    return list(enumerate(docs, 10))


def test_exact(spark, corpus):
    got = {r["doc_id"]: r for r in exact_dedup.dedup(frame(spark, corpus)).collect()}
    expected = brute.exact(corpus)
    assert {i: (r["keep_id"], r["group_size"]) for i, r in got.items()} == expected
    assert all(r["kept"] == (i == r["keep_id"]) for i, r in got.items()) and all(r["locator"] for r in got.values())
    assert sorted(r["doc_id"] for r in exact_dedup.keep(frame(spark, corpus)).collect()) == sorted({k for k, _ in expected.values()})


def test_exact_empty_and_repeated(spark):
    assert exact_dedup.dedup(frame(spark, [])).collect() == []
    rows = exact_dedup.dedup(frame(spark, [(1, "a"), (1, "a"), (2, "b")])).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in rows) == {(1, 1, 2): 2, (2, 2, 1): 1}
    rows = exact_dedup.dedup(frame(spark, [(None, "a"), (1, "a"), (2, None)])).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["kept"]) for r in rows) == [("1", "None", False), ("2", "2", True), ("None", "None", True)]


def test_exact_state_goes_on(spark, tmp_path):
    s = exact_dedup.StreamDedup(spark)
    for n, docs in enumerate([[(5, "a"), (6, "b")], [(3, "a"), (7, "a")]]):
        part = exact_dedup.keyed(frame(spark, docs, 1))
        part.write.mode("append").parquet(str(tmp_path / "in"))
        s.feed(str(tmp_path / "in"), part.schema)
        state = sorted((r["_keep"], r["_rows"]) for r in s.state().collect())
        assert state == ([(5, 1), (6, 1)] if n == 0 else [(3, 3), (6, 1)])


def test_exact_digest_clash_is_split(spark, tmp_path):
    exact_dedup.keyed(frame(spark, [(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "c")], 1)).withColumn("_digest", F.when(F.col("_id") < 4, "clash").otherwise("c")).write.parquet(str(tmp_path / "in"))
    landed = spark.read.parquet(str(tmp_path / "in"))
    s = exact_dedup.StreamDedup(spark)
    s.feed(str(tmp_path / "in"), landed.schema)
    state, none = s.state(), spark.createDataFrame([], "_digest string")
    differing = exact_dedup.differing_hits(landed, state, none)
    assert [r[0] for r in differing.collect()] == ["clash"]
    assert [r[0] for r in exact_dedup.differing_hits(landed, state, state.select("_digest")).collect()] == ["clash"]
    out = landed.join(state, "_digest").select("_id", F.col("_keep").alias("_keep_id"), F.col("_rows").alias("_size"), "_digest", F.lit("").alias("_at"))
    mended = exact_dedup.split_clashes(landed, out, differing).collect()
    assert sorted((r["_id"], r["_keep_id"], r["_size"]) for r in mended) == [(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 2), (5, 4, 2)]


def test_exact_locator_leads_to_the_content(spark, tmp_path):
    landed = exact_dedup.keyed(frame(spark, [(7, "a  b"), (3, "a b"), (5, "c")]))
    landed.write.parquet(str(tmp_path / "in"))
    s = exact_dedup.StreamDedup(spark)
    s.feed(str(tmp_path / "in"), landed.schema)
    rows = spark.read.parquet(str(tmp_path / "in")).select("_norm", "_id", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")).collect()
    at = {(r["file"], r["row"]): (r["_id"], r["_norm"]) for r in rows}
    assert sorted(at[tuple(r["_locator"])] for r in s.state().collect()) == [(3, "a b"), (5, "c")]


def test_exact_leaves_the_session_alone(spark):
    before = dict(spark.conf.getAll)
    exact_dedup.dedup(frame(spark, [(1, "a")])).collect()
    assert {k: v for k, v in spark.conf.getAll.items() if "stateStore" in k or "noDataMicro" in k} == {k: v for k, v in before.items() if "stateStore" in k or "noDataMicro" in k}


@pytest.mark.parametrize("keep", [exact_dedup.keep, minhash_dedup.keep])
def test_keep_keeps_rows_not_ids(spark, keep):
    long = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "x y z a b c", 0), (1, long, 1), (0, long, 2), (0, long, 2), (0, long, 3), (None, "n n n n n n", 4), (None, "n n n n n n", 4), (5, None, 5)], "doc_id long, text string, _kept_id int")
    docs = docs.withColumn("_row_key", F.lit(1)).withColumn("_nth", F.lit(1))
    got = keep(docs)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == {(1, "x y z a b c"): 1, (0, long): 1, (None, "n n n n n n"): 1, (5, None): 1}
    assert keep(docs.limit(0)).collect() == []


def test_words_and_shingles():
    rng = random.Random(2)
    texts = ["".join(rng.choices("aB \t\n\x0b\x0cé x", k=rng.randrange(60))) for _ in range(400)] + [None, "", " ", "a", "x" * 5000]
    for k in (1, 4, 5):
        for t, s in zip(texts, shingles.shingle_sets(texts, k)):
            assert len(s) == len(brute.shingles(t, k)) and (np.diff(s.astype(object)) > 0).all()


def test_long_texts_hash_as_short_ones(monkeypatch):
    t = sentence(random.Random(1), 500)
    whole = shingles.shingle_sets([t], 4)[0]
    monkeypatch.setattr(shingles, "STEP", 64)
    assert (shingles.shingle_sets([t, t], 4)[1] == whole).all()


@pytest.mark.parametrize("block,region,k", [(512, 1024, 5), (4, 1024, 4), (3, 4, 4)])
def test_minhash(spark, corpus, monkeypatch, block, region, k):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    monkeypatch.setattr(minhash_dedup, "REGION", region)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(frame(spark, corpus), words=k).collect()}
    assert got == brute.near(corpus, k)


def test_minhash_blocks_by_bytes(spark, corpus, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK_BYTES", 900)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(frame(spark, corpus), words=4).collect()}
    assert got == brute.near(corpus, 4)


@pytest.mark.parametrize("hot", [False, True])
def test_minhash_recall_at_the_threshold(spark, monkeypatch, hot):
    """Pairs at exactly 0.8, alone or inside a family whose members share long prefixes."""
    monkeypatch.setattr(minhash_dedup, "REGION", 40)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 100)
    rng, family, docs = random.Random(8), [f"f{i}" for i in range(140)], []

    def text(common, own):
        w = common + [f"u{len(docs)}_{i}" for i in range(own)]
        rng.shuffle(w)
        return " ".join(w)

    for p in range(400):
        common = (family + [f"p{p}_{i}" for i in range(20)]) if hot else [f"p{p}_{i}" for i in range(160)]
        for _ in range(2):
            docs.append(text(common, 20))
    if hot:
        for _ in range(1500):
            docs.append(text(family, 60))
    rows = minhash_dedup.near_duplicates(frame(spark, list(enumerate(docs)), 4), words=1).collect()
    got = {r["doc_id"]: r["component_id"] for r in rows}
    assert sum(got[2 * p + 1] == 2 * p for p in range(400)) >= 396
    assert all(got[i] == i for i in got if i >= 800 or i % 2 == 0)


def test_forest_orders_start_apart():
    o = minhash_dedup.orders()
    assert o.shape == (16, 16) and sorted(o[:, :4].ravel().tolist()) == list(range(64)) and all(len(set(x)) == 16 for x in o.tolist())


def test_minhash_hot_region_loses_no_link(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    docs = [" ".join(base)]
    for k in range(60):  # each is near the first only, at 0.80 to 0.83
        w = list(base)
        for at in rng.sample(range(8, 190, 9), 5):
            w[at] = f"x{k}_{at}"
        docs.append(" ".join(w))
    docs = list(enumerate(docs))
    monkeypatch.setattr(minhash_dedup, "REGION", 5)
    expected = brute.near(docs, 4)
    assert {c for _, c in expected.values()} == {0}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(frame(spark, docs), words=4).collect()} == expected


def test_minhash_empty_and_repeated(spark):
    assert minhash_dedup.near_duplicates(frame(spark, [])).collect() == []
    rows = minhash_dedup.near_duplicates(frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, "")])).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows) == {(1, 2, 1, True): 2, (2, 0, 2, True): 1, (3, 0, 3, True): 1}
    rows = minhash_dedup.near_duplicates(frame(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f")])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in rows) == [("1", "1", True), ("2", "1", False), ("None", "None", True)]
    assert minhash_dedup.keep(frame(spark, [(2, "a b c d e f"), (1, "A b c d e f"), (3, None)])).select("doc_id").orderBy("doc_id").collect() == [(1,), (3,)]


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    df = spark.createDataFrame(links, "src long, dst long")
    nodes = sorted({x for p in links if p[0] != p[1] for x in p})
    expected = brute.components(nodes, [p for p in links if p[0] != p[1]])
    assert {r["node"]: r["component"] for r in components.components(df).collect()} == expected
    assert components.components(df.limit(0)).collect() == []


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, _v int, _class long, _dim int")


def brute_vectors(rows):
    ok = {}
    for n, (i, v, *_) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            ok[n] = x / np.linalg.norm(x)
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.9]
    reach = brute.components([r[0] for r in rows], [(rows[a][0], rows[b][0]) for a, b in links])
    degree = Counter(x for p in links for x in p)
    return Counter((r[0], degree[n], reach[r[0]]) for n, r in enumerate(rows))


@pytest.mark.parametrize("target,block,dims", [(512, 2048, 64), (16, 16, 64), (16, 8, 64), (16, 2048, 0)])
def test_vectors(spark, monkeypatch, target, block, dims):
    monkeypatch.setattr(embedding_dedup, "LEAF_TARGET", target)
    if dims == 0:
        monkeypatch.setattr(embedding_dedup, "FITTED_DIMS", 1)
    monkeypatch.setattr(embedding_dedup, "LEAF_ROWS", block)
    rng = np.random.default_rng(8)
    rows = []
    for c in range(40):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 12)):
            rows.append((base + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.25])).astype(np.float32).tolist())
    rows += [rows[0], rows[0], [2 * x for x in rows[0]], [0.0] * 16, None, [], [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, rows[0][:8], rows[0][:8]]
    rows = [(i, v, i % 3, 1, 2, 3) for i, v in enumerate(rows)] + [(0, rows[0], 1, 1, 2, 3)]
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(vectors(spark, rows).repartition(4)).collect())
    assert got == brute_vectors(rows)


def test_vectors_empty(spark):
    assert embedding_dedup.near_duplicates(vectors(spark, [])).collect() == []
    rows = embedding_dedup.near_duplicates(vectors(spark, [(1, None, 0, 0, 0, 0)])).collect()
    assert [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows] == [(1, 0, 1, True)]


def test_forest_depth_and_trees():
    f = embedding_dedup.Forest(64, 1 << 20, np.random.default_rng(1).standard_normal((4096, 64)) / 8, 0.9)
    assert embedding_dedup.Forest(64, 500, np.random.default_rng(1).standard_normal((500, 64)) / 8, 0.9).depth >= 2
    assert f.depth == 10 and f.trees >= 8 and len(f.splits[0]) == 10
    row, tree, leaf = f.route(np.eye(64)[:5])
    assert set(tree) == set(range(f.trees)) and leaf.max() < 1 << 10


def test_a_pair_is_reported_once():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    f = embedding_dedup.Forest(32, 1 << 14, x, 0.9)
    a, b = np.triu_indices(400, 1)
    seen = Counter()
    for t in range(min(f.trees, 6)):
        row, leaf = f.walk(x, t)
        for v in np.unique(leaf):
            own = row[leaf == v]
            i, j = np.triu_indices(len(own), 1)
            i, j = own[i], own[j]
            some = rng.permutation(400)  # another batch gives the same leaves
            back = np.argsort(some)
            for k in embedding_dedup.first_met(f, x[some], back[i], back[j], t, int(v)).tolist():
                seen[int(min(i[k], j[k])), int(max(i[k], j[k]))] += 1
    met = {(p, q) for t in range(min(f.trees, 6)) for row, leaf in [f.walk(x, t)] for v in np.unique(leaf) for own in [np.sort(row[leaf == v])] for n, p in enumerate(own.tolist()) for q in own[n + 1 :].tolist()}
    assert set(seen) == met and set(seen.values()) == {1} and len(a) >= len(met)
    r = embedding_dedup.smallest(8, np.array([5, 3, 6]), np.array([3, 1, 7]))
    assert r.tolist() == [0, 1, 2, 1, 4, 1, 6, 6]


def test_forest_finds_pairs_inside_a_hot_cluster():
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((30_000, 64)))
    x[:10_000] = unit(0.9**0.5 * unit(rng.standard_normal(64)) + 0.1**0.5 * unit(rng.standard_normal((10_000, 64))))
    f = embedding_dedup.Forest(64, 1 << 20, x[rng.permutation(len(x))[: embedding_dedup.SAMPLE]], 0.9)
    assert f.depth == 10
    a, b = rng.integers(0, 10_000, (2, 30_000))
    at = np.flatnonzero((abs((x[a] * x[b]).sum(axis=1) - 0.9015) < 0.0015) & (a != b))[:800]
    met = 0
    for k in range(0, 800, 100):
        one, other = ({*zip(*(v.tolist() for v in f.route(x[i[at[k : k + 100]]])))} for i in (a, b))
        met += len({r for r, _, _ in one & other})
    assert len(at) == 800 and met >= 799


@pytest.mark.parametrize("shard", [2 << 20, 3000])
def test_repeats(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    rng = random.Random(6)
    passages = [sentence(rng, 120, 5000) for _ in range(4)]
    docs = []
    for i in range(60):
        parts = [sentence(rng, rng.randrange(5, 120), 5000)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 200)
            parts += [p[a : a + rng.randrange(300, 700)], sentence(rng, rng.randrange(3, 60), 5000)]
        docs.append(" ".join(parts))
    docs += [docs[3], docs[3], None, "", "é" * 200, "é" * 199, "é" * 200 + "x", "ab" * 400, "x" * 399, "y" * 400, "z" * 401, "q" * 3000 + docs[5]]
    rows = list(enumerate(docs))
    got = {r["doc_id"]: r for r in suffix_dedup.repeats(frame(spark, rows)).collect()}
    for (i, t), (n, removed, spans, kept) in zip(rows, brute.repeats(docs, 400)):
        r = got[i]
        raw = (t or "").encode()
        assert (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"] or []), len(r["spans"] or [])) == (n, removed, spans), i
        import hashlib

        assert hashlib.sha256(raw if r["kept"] is None else bytes(r["kept"])).hexdigest() == kept
    shared = brute.passages(docs, suffix_dedup.PASSAGE)
    assert [got[i]["n_passages"] for i, _ in rows] == shared and sum(shared) > 20


def test_repeats_empty(spark):
    assert suffix_dedup.repeats(frame(spark, [])).collect() == []
    rows = suffix_dedup.repeats(frame(spark, [(1, "a" * 500), (1, "a" * 500)])).collect()
    assert [(r["n_bytes"], bytes(r["kept"])) for r in rows] == [(500, b"")] * 2
    words = sentence(random.Random(1), 300, 5000)
    rows = suffix_dedup.repeats(frame(spark, [(None, words + " tail one"), (7, words + " end"), (None, None)])).collect()
    assert sorted((r["n_bytes"], bytes(r["kept"] or b"")) for r in rows) == [(0, b""), (len(words) + 4, b"end"), (len(words) + 9, b"tail one")]


@pytest.mark.parametrize("ranks", [suffix_dedup.RANKS, 0])
def test_suffix_arrays_against_counts(monkeypatch, ranks):
    monkeypatch.setattr(suffix_dedup, "RANKS", ranks)
    rng = random.Random(9)
    for trial in range(30):
        w = rng.choice([40, 64, 400])
        base = ["".join(rng.choices("ab", k=rng.randrange(900))) for _ in range(4)]
        strings = []
        for _ in range(8):
            t = "".join(b[i : i + rng.randrange(500)] for b in rng.choices(base, k=3) for i in [rng.randrange(len(b) + 1)])
            strings.append(t.encode())
        strings += [b"a" * 900, b"\0" * 700] if trial % 5 == 0 else []
        count = Counter(s[i : i + w] for s in strings for i in range(len(s) - w + 1))
        at, expected = 0, set()
        for s in strings:
            expected |= {at + i for i in range(len(s) - w + 1) if count[s[i : i + w]] > 1}
            at += len(s)
        assert set(suffix_dedup.Shard(strings, w).repeated().tolist()) == expected
        a, b = suffix_dedup.Shard(strings[:4], w), suffix_dedup.Shard(strings[4:], w)
        other = {s[i : i + w] for s in strings[4:] for i in range(len(s) - w + 1)}
        at, expected = 0, set()
        for s in strings[:4]:
            expected |= {at + i for i in range(len(s) - w + 1) if s[i : i + w] in other}
            at += len(s)
        assert set(a.find(b)[0].tolist()) == expected


def test_anchors_own_every_start_once(monkeypatch):
    rng = random.Random(4)
    raws = [bytes(rng.randrange(97, 123) for _ in range(rng.randrange(0, 3000))) for _ in range(30)] + [b"a" * 2500]
    one = suffix_dedup.anchors(raws)
    for k, r in enumerate(raws):
        own = one[0] == k
        assert (one[2][own] - one[1][own] + 1).sum() == max(0, len(r) - 399)
        for lo, hi, p in zip(one[1][own], one[2][own], one[4][own]):
            for a, b, (c, d) in suffix_dedup.halves(int(lo), int(hi), int(p), 400):
                assert a <= b and c >= b and d <= a + 400
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    assert all((x == y).all() for x, y in zip(one, suffix_dedup.anchors(raws)))


def test_spread_joins_equal_plain_ones(spark):
    from strandlog.llm._common import fresh, heavy_keys, land, once, row_key, spread_join, unland

    left = spark.range(4000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id") % 50).alias("k"), "id", F.lit(1).alias("_salt"), F.lit(2).alias("_heavy"))
    right = spark.range(40).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v"))
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("_rows"))
    heavy = heavy_keys(counts, least=100)
    assert [r["k"] for r in heavy.collect()] == [7] and heavy_keys(counts, least=5000) is None and heavy_keys(counts.limit(0)) is None
    for how in ("inner", "left", "left_semi"):
        got, plain = spread_join(left, right, ["k"], heavy, how), spread_join(left, right, ["k"], None, how)
        assert got.columns == plain.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, plain.collect()))
    spread = spread_join(left, right, ["k"], heavy).withColumn("p", F.spark_partition_id())
    assert spread.sparkSession.conf.get("spark.sql.shuffle.partitions") == "4" and spread.count() > 3000
    assert fresh("_K", left.withColumn("_k", F.lit(1))) == "_K_"
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "a"), (2, None)], "i long, t string")
    assert once(rows.withColumn("_key", row_key(F.col("i"), F.col("t"))), "_key").count() == 3
    landed = land(rows, "some")
    assert landed.count() == 5
    unland(landed)
    unland(rows)  # not landed: nothing of it goes
    with pytest.raises(Exception):
        landed.count()
