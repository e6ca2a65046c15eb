"""Joins, archives, searches, mixtures, shards and the pipeline against plain versions."""

import gzip
import hashlib
import os
import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from cases import WORDS, awkward, documents, text

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import DATA, check, views
from pyspark.sql import functions as F

from momentquery.llm import common, components, jaccard, mixing, queries, sharding, vptree, warc


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    from momentquery.session import ship

    ship(spark)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_rows_match_sql(spark, name):
    assert check(queries.QUERIES[name](spark, DATA), queries.ORACLE[name], views()) > 0


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_rows_without_sql(spark, name):
    import duckdb

    n = duckdb.sql(f"select count(*) from '{DATA}/documents.parquet'").fetchall()[0][0]
    got = queries.QUERIES[name](spark, DATA)
    assert got.count() == n or name.startswith("op7")
    assert "doc_id" in got.columns


def sets(t, width):
    w = (t or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if len(w) >= width else frozenset([tuple(w)])


def plain_components(ids, texts, width, percent):
    s = [sets(t, width) for t in texts]
    root = list(range(len(s)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(s)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {ids[i]: (len(s[i]), least[find(i)]) for i in range(len(s))}


@pytest.mark.parametrize(("width", "percent", "hot"), [(4, 85, 16), (5, 80, 16), (2, 50, 2)])
def test_jaccard_components(spark, monkeypatch, width, percent, hot):
    rng = random.Random(width)
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "SALT", 8)
    monkeypatch.setattr(jaccard, "SEEN_IN_TASK", 2)
    texts = []
    for _ in range(12):
        base = text(rng, rng.randint(3, 120)).split()
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
    shared = text(rng, 40)
    texts += [shared + " " + text(rng, 6) for _ in range(30)] + [t for t in awkward(rng) if t is None or len(t) < 1000] + ["same words here now ok"] * 20
    ids = rng.sample(range(1000), len(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(documents(spark, texts, ids), width, percent).collect()}
    assert got == plain_components(ids, texts, width, percent)


def test_jaccard_repeated_ids(spark):
    """Rows that share an id and differ in text are documents of their own; no link of either is lost."""
    rows = [(1, "a b c d e f g h i j"), (5, "a b c d e f g h i j x1"), (5, "q w e r t y u i o p"), (9, "Q w e r t y u i o p"), (5, "a b c d e f g h i j x1")]
    got = jaccard.components(documents(spark, [t for _, t in rows], [i for i, _ in rows]), 2, 50)
    keys = documents(spark, [t for _, t in rows], [i for i, _ in rows]).select("text", jaccard.text_key(F.col("text")).alias("text_key"))
    found = {(r.doc_id, r.text): r.component_id for r in got.join(keys.distinct(), "text_key").collect()}
    assert got.count() == 5 and found == {(1, rows[0][1]): 1, (5, rows[1][1]): 1, (5, rows[2][1]): 5, (9, rows[3][1]): 5}


def test_groups_of_one_prefix(spark, monkeypatch):
    """Sets of equal size and prefix that differ behind it are one group; members link or not by their whole sets."""
    monkeypatch.setattr(jaccard, "HOT", 4)
    monkeypatch.setattr(jaccard, "SALT", 3)
    monkeypatch.setattr(jaccard, "frequent", lambda documents, width: np.zeros(0, np.uint64))  # the order is that of hashes
    largest = []
    plain = jaccard._grouped
    monkeypatch.setattr(jaccard, "_grouped", lambda classes: (g := plain(classes), largest.append(g.agg(F.max("size")).first()[0]))[0])
    rng = random.Random(3)
    words = sorted((f"w{i}" for i in range(200)), key=lambda w: int(jaccard.shingle_sets(pa.array([w]), 1)[0][0]))
    texts = []
    for first in (0, 5):  # two groups whose prefixes overlap
        for _ in range(5):
            rest = rng.sample(words[20:], 20)
            for _ in range(6):
                some = list(rest)
                for _ in range(rng.choice([0, 1, 3])):
                    some[rng.randrange(20)] = rng.choice(words[20:])
                texts.append(" ".join(words[first : first + 10] + some))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(documents(spark, texts), 1, 70).collect()}
    assert got == plain_components(list(range(len(texts))), texts, 1, 70) and largest[0] > 10
    assert 2 < len({c for _, c in got.values()}) < len(texts)


def test_jaccard_edges(spark):
    assert jaccard.components(documents(spark, [])).count() == 0
    rows = jaccard.components(documents(spark, ["a b c d e f"] * 3 + [None], [None, 2, 2, 3])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in rows if r.doc_id is not None) == [(False, 2, 2), (False, 2, 2), (False, 3, 3)]
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    long = text(random.Random(1), 20000)
    rows = jaccard.components(documents(spark, [long, long.upper() + " more"])).collect()
    assert {r.component_id for r in rows} == {0}


def test_marks_never_leave_out_a_link():
    rng = np.random.default_rng(0)
    for n in (50, 1500, 5000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 10 :], rng.integers(0, 2**63, n // 20, dtype=np.uint64)]))
        differ = len(np.setxor1d(a, b))
        for bits in (jaccard.MARKS, jaccard.fine_bits(n)):
            assert int(np.bitwise_count(jaccard.marks(a, bits) ^ jaccard.marks(b, bits)).sum()) <= differ
    wide, narrow = jaccard.marks(a, 4096), jaccard.marks(a, 1024)
    assert np.array_equal(np.bitwise_xor.reduce(wide.reshape(4, -1), axis=0), narrow)


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(40, 41), (41, 42), (7, 7)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 41: 40, 42: 40}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_settled_gives_freed_memory_back(spark):
    """The driver's process loses what its virtual machine has freed outside of the heap, between pieces still in use."""
    jvm = spark._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    resident = lambda: int(re.search(r"RssAnon:\s+(\d+)", status.read_text())[1]) // 1024
    jvm.java.lang.System.gc()
    before = resident()
    held = [jvm.java.util.zip.Deflater() for _ in range(2000)]  # some 90 kB each are touched
    full = resident()
    for i, one in enumerate(held):
        if i % 16:
            one.end()
    common.settled(spark)
    assert full > before + 100 and resident() < full - (full - before) // 2
    for one in held[::16]:
        one.end()


def plain_nearest(q, rows, k):
    out = []
    for i, x in q:
        scored = []
        for j, y in rows:
            if j != i and len(x) == len(y):
                s = 0.0
                for a, b in zip(x, y):
                    s += float(a) * float(b)
                scored.append((-s, j))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, key string, block string, shard string"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x") for i, v in rows], VECTORS)


def test_search_is_exact_at_factor_one(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=6) * (1 + i % 3)]) for i in range(240)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]  # ties
    bad = [(2000, None), (2001, [0.0] * 6), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (2004, [None] * 6), (2005, []), (2006, [1.0, 2.0]), (None, [1.0] * 6)]
    df = _vectors(spark, rows + bad)
    found = vptree.nearest(df.filter("vec_id % 20 = 0"), df, k=20, shard_rows=60, block_rows=5)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())
    assert got == plain_nearest([r for r in rows if r[0] % 20 == 0], rows, 20)
    # However rows are dealt to tasks and whatever the shards, the same rows are found.
    again = vptree.nearest(df.filter("vec_id % 20 = 0").repartition(7), df.repartition(5), k=20, shard_rows=17, block_rows=3)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in again.collect()) == got
    short = vptree.nearest(df.filter("vec_id = 0"), df.filter("vec_id < 5"), k=20).collect()
    assert [r["rank"] for r in sorted(short, key=lambda r: r["rank"])] == [1, 2, 3, 4]
    assert vptree.nearest(df.limit(0), df.limit(0)).count() == 0


def test_larger_factors_look_at_less_and_find_most(monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8)) * 4
    x = centres[rng.integers(20, size=4000)] + rng.normal(size=(4000, 8)) * 0.3
    t = pa.table({"vec_id": np.arange(4000), "embedding": pa.array([v.tolist() for v in x])})
    q, looked = t.slice(0, 100), []
    add = vptree.Best.add
    monkeypatch.setattr(vptree.Best, "add", lambda self, rows, x, ids: (looked.append(len(rows) * len(ids)), add(self, rows, x, ids))[1])
    found, cost = [], []
    for factor in (1.0, 1.05, 1.5):
        looked.clear()
        r = vptree.searched(q, t, 10, factor, leaf=32)
        found.append(set(zip(r["query_id"].to_pylist(), r["vec_id"].to_pylist())))
        cost.append(sum(looked))
    assert cost[0] > cost[1] > cost[2] and cost[0] < 0.4 * 100 * 4000
    assert len(found[0] & found[1]) >= 0.9 * len(found[0]) and len(found[0] & found[2]) < len(found[0])


def test_archives(spark, tmp_path):
    body = "<p>" + "x" * 1200
    tricky = "WARC/1.1\r\n\r\n\r\nContent-Length: 5\r\n\r\n" + "y" * 1100
    pages = [(1, "http://a\r\nX: y", body), (5, None, body), (3, "http://c", body), (7, "u", "short"), (8, "u", "short"), (9, "u", None), (None, "n", body), (10, "t", tricky), (11, "t", tricky), (12, "é", "ü" * 700)]
    df = spark.createDataFrame(pages, "record_id long, url string, payload string").withColumn("payload_digest", warc.digest(F.col("payload")))
    df = df.withColumn("payload_bytes", F.octet_length(F.coalesce("payload", F.lit(""))))
    resolved = warc.resolve_revisits(df)
    at = str(tmp_path / "w")
    warc.write_warc(resolved, at, per_file=3)
    read = warc.read_warc(spark, at)
    rows = {r.record_id: r for r in warc.with_payloads(read).collect()}
    assert len(rows) == len(pages)
    for i, _, p in pages:
        assert rows[i].payload_bytes == len((p or "").encode()) and rows[i].payload_digest == hashlib.sha1((p or "").encode()).hexdigest()
    assert {i: r.refers_to for i, r in rows.items() if r.record_type == "revisit"} == {1: 5, 3: 5, None: 5, 10: 11}
    texts = {r.record_id: r.payload for r in read.collect()}
    assert bytes(texts[11]).decode() == tricky and texts[10] is None and bytes(texts[12]).decode() == "ü" * 700
    again = warc.with_payloads(warc.deduplicated(spark, at, str(tmp_path / "w2")))
    key = lambda r: (r.record_id is None, r.record_id or 0)
    assert [(r.record_id, r.record_type, r.refers_to, r.payload_bytes) for r in sorted(again.collect(), key=key)] == [(r.record_id, r.record_type, r.refers_to, r.payload_bytes) for r in sorted(rows.values(), key=key)]


def test_foreign_archives(spark, tmp_path):
    one = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:x>\r\nContent-Length: 9\r\n\r\nH: 1\r\n\r\nz\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    got = [(r.record_type, r.record_id, None if r.payload is None else bytes(r.payload)) for r in warc.read_warc(spark, str(tmp_path)).collect()]
    assert got == [("warcinfo", None, None), ("response", None, b"z")]
    with pytest.raises(ValueError):
        list(warc.parsed([b"nothing\r\n\r\n"]))
    for cut in (one[:-1], one[:20], one[:-4] + b"abcd"):
        with pytest.raises(ValueError):
            list(warc.parsed([cut]))
    whole = list(warc.parsed([one + two]))
    for n in range(1, 40, 3):
        assert list(warc.parsed((one + two)[i : i + n] for i in range(0, len(one + two), n))) == whole
    with pytest.raises(ValueError):
        list(warc.inflated(gzip.compress(one)[:-9]))


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "record_id long, url string, payload string, payload_digest string, payload_bytes int")
    warc.write_warc(warc.resolve_revisits(none), str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 0


def test_exponents():
    tokens = {"a": 1000, "b": 100, "c": 10, None: 0}
    for limit in (1.5, 3.0, 50.0):
        a = mixing.bisected(tokens, limit=limit, budget=1110.0)
        assert mixing.repeats(tokens, a, 1110.0) <= limit + 1e-6
        assert a == 0 or mixing.repeats(tokens, a, 1110.0) == pytest.approx(limit)
    low, high = mixing.entropy(mixing.weights(tokens, 1.0)), mixing.entropy(mixing.weights(tokens, 0.0))
    middle = (low + high) / 2
    assert mixing.entropy(mixing.weights(tokens, mixing.bisected(tokens, target_entropy=middle))) == pytest.approx(middle)
    assert mixing.bisected(tokens, target_entropy=9.0) == 0 and mixing.bisected(tokens, target_entropy=0.0) == 1


@pytest.mark.parametrize("blocks", [16, None])
def test_mixture_is_a_prefix_of_each_permutation(spark, blocks):
    rng = random.Random(8)
    texts = [text(rng, rng.randint(1, 30)) for _ in range(300)] + [None, ""]
    sources = [rng.choice(["a"] * 8 + ["b", None]) for _ in texts]
    df = documents(spark, texts, None, sources).withColumn("tokens", mixing.n_tokens(F.col("text")))
    tokens = mixing.source_tokens(df, tokens="tokens")
    assert tokens == {s: sum(len((t or "").split()) for t, x in zip(texts, sources) if x == s) for s in {"a", "b", None}}
    mix = mixing.shares(tokens, budget=1.3 * sum(tokens.values()), limit=4.0)
    out = mixing.realised(df, mix, tokens="tokens", blocks=blocks)
    assert set(df.columns) < set(out.columns)
    every = mixing.realised(df, [mixing.Share(s.source, s.tokens, s.weight, 6.0 * s.tokens) for s in mix], tokens="tokens", blocks=blocks)
    order = {}
    for r in every.collect():
        order.setdefault((r.source, r.taken.epoch), []).append((r.taken.block, r.taken.place, r.doc_id, r.tokens))
    got = {}
    for r in out.collect():
        got.setdefault((r.source, r.taken.epoch), set()).add(r.doc_id)
    for s in mix:
        whole = int(s.epochs + 1e-9)
        rest = s.budget - whole * s.tokens
        for e in range(whole):
            assert got[s.source, e] == {d for _, _, d, _ in order[s.source, e]}
        want, used = set(), 0
        for _, _, d, n in sorted(x for x in order[s.source, whole] if x[3]):
            if used + n > rest:
                break
            used += n
            want.add(d)
        assert got.get((s.source, whole), set()) == want
    assert mixing.realised(df.limit(0), [], tokens="tokens").count() == 0


def test_without_budget_every_document_is_there(spark):
    df = documents(spark, ["a b c"] * 9 + ["x"] * 2 + [None], None, ["s"] * 9 + ["t"] * 3).withColumn("tokens", mixing.n_tokens(F.col("text")))
    out = mixing.realised(df, mixing.shares(mixing.source_tokens(df, tokens="tokens"), limit=2.0), tokens="tokens")
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert set(n) == set(range(12)) and max(n.values()) == 2


def test_slots_and_maps(spark, tmp_path):
    rng = random.Random(9)
    rows = [(None if i % 97 == 0 else i, rng.randint(1, 5000)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, size long").withColumn("virtual_slot", sharding.virtual_slot(F.col("doc_id"), n_slots=256))
    sizes = sharding.slot_sizes(df, 256)
    first = sharding.stored_map(sharding.first_map(spark, 8, 256), str(tmp_path / "m"), 0)
    edited = sharding.edited_map(sizes, first, 8)
    second = sharding.stored_map(edited, str(tmp_path / "m"), 1)
    out = sharding.sharded(df, ["doc_id", "size"], second.drop("moved"), sizes)
    assert out.columns == [*df.columns, "placed"]
    out = out.select("*", "placed.*")
    per = {r.shard: (r.b, r.n, r.lo, r.hi, r.d) for r in out.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.countDistinct("slot").alias("d")).collect()}
    assert all(lo == 0 and hi == n - 1 and d == n for _, n, lo, hi, d in per.values())
    assert max(p[0] for p in per.values()) <= 1.03 * min(p[0] for p in per.values())
    moved = second.join(first.withColumnRenamed("shard", "was"), "virtual_slot").filter("moved <> (shard <> was)")
    assert moved.count() == 0
    grown = sharding.edited_map(sizes, second.drop("moved"), 9, into=8)
    changes = grown.join(second.select("virtual_slot", F.col("shard").alias("was")), "virtual_slot").filter("shard <> was")
    assert changes.count() > 0 and {r.shard for r in changes.collect()} == {8}
    assert sharding.read_map(spark, str(tmp_path / "m"), 0).filter("map_version = 0").count() == 256
    none = sharding.slot_sizes(df.limit(0), 256)
    assert none.agg(F.sum("n_rows")).first()[0] == 0 and sharding.sharded(df.limit(0), ["doc_id"], second.drop("moved"), none).count() == 0


def plain_shards(rows, n_shards=16, n_slots=sharding.N_SLOTS):
    """Rows (doc_id, text) as (doc_id, size, checksum, shard, place), by a plain version of the whole query."""
    import struct
    import zlib

    import xxhash

    def spark_hash(values):
        seed = 42
        for v in values:
            if v is not None:
                seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=seed)
        return seed - (1 << 64) if seed >= 1 << 63 else seed

    full = []
    for i, t in rows:
        data = (t or "").encode()
        full.append((i, len(data) + 1, zlib.crc32(data), spark_hash([i, zlib.crc32(data)]) % n_slots))
    size = Counter()
    for _, n, _, s in full:
        size[s] += n
    shard = {s: s % n_shards for s in range(n_slots)}
    load = [sum(size[s] for s in range(k, n_slots, n_shards)) for k in range(n_shards)]
    for s in sorted(shard, key=lambda s: (-size[s], s)):
        to = load.index(min(load))
        if load[to] + size[s] < load[shard[s]]:
            load[to] += size[s]
            load[shard[s]] -= size[s]
            shard[s] = to
    nulls_first = lambda x: (x is not None, x or 0)
    place, out = Counter(), []
    for i, n, c, s in sorted(full, key=lambda r: (r[3], nulls_first(r[0]), r[1], r[2])):
        out.append((i, n, c, shard[s], place[shard[s]]))
        place[shard[s]] += 1
    return sorted(out, key=str)


def test_sharding_query_is_the_plain_one(spark, tmp_path):
    rng = random.Random(12)
    texts = [*awkward(rng), *(text(rng, rng.randint(1, 200)) for _ in range(200))]
    ids = [None if i % 9 == 0 else i // 2 for i in range(len(texts))]
    documents(spark, [*texts, *texts[:20]], [*ids, *ids[:20]]).write.parquet(f"{tmp_path}/documents.parquet")
    for place in (str(tmp_path), DATA):
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{place}/documents.parquet").collect()]
        got = queries.QUERIES["op10_virtual_slots"](spark, place).collect()
        assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got), key=str) == plain_shards(rows)
        assert {(r.law, r.grown_shard, r.map_version) for r in got} == {("bytes", None, 1)}
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert max(sizes.values()) <= 1.03 * min(sizes.values())


TAKEN = ["toxicity", "_Toxicity", "grade", "tails", "toxic_score", "coded", "pieces", "taken", "epoch", "block", "place", "n_tokens", "placed", "slot", "shard", "map_version", "row", "key", "id", "n", "component_id", "a.b"]


def test_columns_of_any_name_come_out_as_they_went_in(spark):
    import corpus_pipeline as cp

    from momentquery.llm import quality, sentencepieces, toxicity

    rng = random.Random(13)
    rows = [(i, text(rng, 30), "s", *[f"{i}:{c}" for c in TAKEN]) for i in range(12)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *[f"`{c}` string" for c in TAKEN]]))
    want = sorted(tuple(r) for r in rows)
    n = len(df.columns)
    chain, model = toxicity.Chain(), quality.Grades(np.zeros(quality.N_WEIGHTS), (-1.0, 1.0))
    share = [mixing.Share("s", 360, 1.0, 360.0)]
    slots = df.withColumn("virtual_slot", F.lit(0))
    sizes = sharding.slot_sizes(slots.select("virtual_slot", F.lit(1).alias("size")), 4)
    first = sharding.first_map(spark, 2, 4).withColumn("map_version", F.lit(0))
    for out in (
        toxicity.score(df, chain),
        quality.graded(df, model, 3),
        sentencepieces.encoded(df, sentencepieces.load(queries.queries_sentencepieces.model_path())),
        mixing.realised(df.withColumn("w", mixing.n_tokens(F.col("text"))), share, tokens="w").drop("w"),
        sharding.sharded(slots, ["doc_id"], first, sizes).drop("virtual_slot"),
    ):
        assert out.columns[:n] == df.columns and len(out.columns) == n + 1
        assert sorted(tuple(r)[:n] for r in out.collect()) == want
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, df, DATA)
        assert out.columns == df.columns and {tuple(r) for r in out.collect()} <= set(want)
    assert sorted(tuple(r) for r in cp.mixed(spark, df, DATA).collect()) == want


def test_one_of_each_keeps_one_row_of_a_group(spark):
    import corpus_pipeline as cp

    one, two = "a b c d e f g h i j k l m n o p", "q r s t u v w x y z a a b b c c"
    rows = [(7, one), (3, one), (3, one), (5, two), (5, one), (9, two), (None, one), (None, one), (11, None), (12, ""), (13, None)]
    got = cp.one_of_each(spark, documents(spark, [t for _, t in rows], [i for i, _ in rows]), DATA).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(3, one), (5, two), (None, one), (None, one), (11, None), (12, ""), (13, None)], key=str)


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    from momentquery.llm import quality, toxicity
    from momentquery.llm.common import table, written
    from momentquery.llm.queries_quality import GRADE, N_GRADES

    docs = table(spark, DATA, "documents")
    labels = table(spark, DATA, "labels")
    rows = {r.doc_id: r for r in docs.collect()}
    tagger = toxicity.Tagger(toxicity.fit(docs, labels))
    grader = quality.Grader(quality.fit(docs, labels, GRADE, N_GRADES))
    left = {i for i, r in rows.items() if next(tagger.tagged(pa.array([r.text])))[0][0] < 0.5}
    after = written(cp.drop_toxic(spark, docs, DATA), "t")
    assert {r.doc_id for r in after.collect()} == left and after.columns == docs.columns
    left = {i for i in left if grader.tails(rows[i].text)[0] >= 0.5}
    after = written(cp.drop_poor(spark, after, DATA), "t")
    assert {r.doc_id for r in after.collect()} == left and after.columns == docs.columns
    ids = sorted(left)
    left = {i for i, (_, c) in plain_components(ids, [rows[i].text for i in ids], cp.WIDTH, cp.PERCENT).items() if i == c}
    after = written(cp.one_of_each(spark, after, DATA), "t")
    assert {r.doc_id for r in after.collect()} == left and after.columns == docs.columns
    after = written(cp.mixed(spark, after, DATA), "t")
    n = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert set(n) == left and max(n.values()) <= 2 and after.columns == docs.columns
    coded = cp.encoded(spark, after, DATA)
    assert coded.count() == sum(n.values()) and coded.filter("not exact").count() == 0
    assert {r.doc_id for r in cp.run(spark, DATA).collect()} == left


ALONE = """
import sys
sys.path.insert(0, sys.argv[1])
import corpus_pipeline as cp
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
text = "one of many words that are the same in both"
docs = spark.createDataFrame([(1, text, "web"), (2, text, "web"), (3, "another text", "web")], "doc_id long, text string, source string")
stage = dict(cp.STAGES)[sys.argv[3]]
print("ROWS", sorted(r.doc_id for r in stage(spark, docs, "").collect()))
print("BATCH", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
"""


@pytest.mark.parametrize("stage, ids", [("near duplicates", [1, 3]), ("sentencepieces", [1, 2, 3])])
def test_stage_runs_by_itself(tmp_path, stage, ids):
    """In an application that has read no table of ours, whose workers don't find the package by their path."""
    repo = Path(__file__).resolve().parents[2]
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    run = subprocess.run([sys.executable, "-B", "-c", ALONE, str(repo), str(tmp_path / "shared"), stage], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert f"ROWS {ids}" in run.stdout, run.stderr[-3000:]
    assert "BATCH 4m" in run.stdout
