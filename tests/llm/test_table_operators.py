"""Operators on whole tables: mixing, sharding, near-duplicates and token output, and the pipeline."""

import random
import string
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchloom.llm import mixing, queries, sharding, simhash, tokens, vectors
from watchloom.llm.common import Workspace, connected_components


def roots(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(Workspace(spark), spark.createDataFrame(edges, "a long, b long")).collect()}
    found = roots(600, edges)
    low = defaultdict(lambda: 600)
    for i, r in enumerate(found):
        low[r] = min(low[r], i)
    assert got == {i: low[found[i]] for e in edges if e[0] != e[1] for i in e}


# Mixing.


def shares(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by the rule itself: reshare the excess until no source is above its bound."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, full, target = share * sum(sizes.values()), set(), {}
    while True:
        open_ = [s for s in names if s not in full]
        left = budget - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in open_) for s in names}
        over = {s for s in open_ if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix_against_rule(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(500)]
    got = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    target, taken = shares(sizes), Counter()
    for r in got:
        source = rows[r.doc_id][2]
        assert r.size == len(rows[r.doc_id][1].split()) and r.source_size == sizes[source]
        assert abs(r.target - target[source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    assert all(0 <= target[s] - taken[s] < 60 for s in sizes)
    assert sorted(got) == sorted(mixing.mix_documents(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).collect())


def test_mix_takes_part_of_repeated_rows(spark):
    rows = [(None, "a b c", "x")] * 300 + [(i, "d e", "y") for i in range(50)] + [(7, "f g h i", "z")] * 90
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    target = shares({"x": 900, "y": 100, "z": 360})
    taken = Counter()
    for r in mixing.mix_documents(docs).collect():
        taken[{900: "x", 100: "y", 360: "z"}[r.source_size]] += r.taken
    assert all(0 <= target[s] - taken[s] < 5 for s in target)
    again = Counter(r.source for r in mixing.repeat_documents(docs).collect())
    assert all(abs(target[s] - again[s] * n) < 5 for s, n in (("x", 3), ("y", 2), ("z", 4)))


def test_larger_budgets_nest(spark):
    rows = spark.range(400).select(F.lit("s").alias("source"), (F.col("id") % 7).alias("size"), F.pmod(F.xxhash64("id"), F.lit(1 << 60)).alias("h"))
    below = [mixing.thresholds(Workspace(spark), rows, spark.createDataFrame([("s", b)], "source string, budget double")).first().below for b in (0.0, 100.0, 500.0, 1e9)]
    assert below == sorted(below)
    exact = sorted((r.h, r.size) for r in rows.collect())
    for b, limit in zip((0.0, 100.0, 500.0, 1e9), below, strict=True):
        total = 0
        for h, size in exact:
            if total + size > b:
                assert limit == h
                break
            total += size
        else:
            assert limit == 1 << 60


def test_mix_on_odd_rows(odd, empty):
    got = mixing.mix_documents(odd).collect()
    assert len(got) == 12 and all(r.taken <= 2 * r.size for r in got)
    again = mixing.repeat_documents(odd)
    assert again.columns == odd.columns
    words = {r.size: 0 for r in got}
    assert sum(len((r.text or "").split()) for r in again.collect()) == sum(r.taken for r in got) and words
    assert mixing.mix_documents(empty).count() == 0 and mixing.repeat_documents(empty).count() == 0
    assert all(r.target == 0 and r.taken == 0 for r in mixing.mix_documents(odd.where("doc_id <= 3")).collect())


# Sharding.


def test_rendezvous_against_plain_scores(spark):
    """The winner by its definition, over Spark's own hash of (key, shard)."""
    rows = spark.range(400).select(F.concat(F.lit("d:"), F.col("id").cast("string")).alias("key"), F.col("id"))
    for weights in ([1.0] * 16, [1.0] * 17, [1.0, 2.5, 0.5]):
        got = rows.select("key", sharding.rendezvous(F.col("key"), weights).alias("w"), F.array(*[F.xxhash64("key", F.lit(i)) for i in range(len(weights))]).alias("h")).collect()
        for r in got:
            u = [(((h & (1 << 64) - 1) >> 11) + 0.5) / 2**53 for h in r.h]
            assert r.w == min(range(len(weights)), key=lambda i: (-np.log(u[i]) / weights[i], i))
    shards = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard_documents(rows.select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))).collect()}
    for n, i in ((16, 0), (17, 1)):
        want = {r.id: r.w for r in rows.select("id", sharding.rendezvous(F.col("key"), [1.0] * n).alias("w")).collect()}
        assert want == {k: v[i] for k, v in shards.items()}


def test_rows_of_one_key_are_numbered_apart(spark):
    """Equal rows share a shard but not a numbering range."""
    docs = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.shard_documents(docs).collect()
    assert len({r.shard for r in got}) == 1 and sorted(r.slot for r in got) == list(range(5000))


def test_shards(spark, odd, empty):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("té"), (F.col("id") % 5).cast("string")).alias("text"))
    got = sharding.shard_documents(docs).collect()
    slots = defaultdict(list)
    for r in got:
        text = f"té{r.doc_id % 5}".encode()
        assert (r.size, r.text_crc32, r.law) == (len(text) + 1, zlib.crc32(text), "key")
        assert r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(r.grown_shard == 16 for r in got)
    assert 120 < moved < 240
    heavy = Counter(r.shard for r in sharding.shard_documents(docs, (1.0, 3.0)).collect())
    assert 2.5 < heavy[1] / heavy[0] < 3.6
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == 12 and len({(r.shard, r.slot) for r in rows}) == 12
    assert next((r.size, r.text_crc32) for r in rows if r.doc_id == 1) == (1, 0)
    assert len({r.shard for r in rows if r.doc_id == 5}) == 1
    assert sharding.shard_documents(empty).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit("a"), [1.0, 0.0])


# SimHash.


def slow_fingerprint(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    for text in (None, "", " \x0b ", "One", "one two THREE", "a b c d", "a b c d e É é\x85f g", "x y " * 300):
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert spark.sql("select xxhash64('a b c d')").first()[0] & (1 << 64) - 1 == simhash.fingerprint("A b\tc d")


@pytest.mark.parametrize("group_rows", [200_000, 3])
def test_trie_join_matches_all_pairs(spark, group_rows):
    rng = random.Random(6)
    fps = []
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.append(base)
            for _ in range(rng.randint(0, 6)):
                fps[-1] ^= 1 << rng.randrange(64)
            base = fps[-1] if rng.random() < 0.3 else base
    ids = rng.sample(range(1000), len(fps))
    found = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    low = defaultdict(lambda: 1000)
    for i, r in enumerate(found):
        low[r] = min(low[r], ids[i])
    rows = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in zip(ids, fps, strict=True)], "doc_id long, fp long")
    got = rows.join(simhash.component_ids(Workspace(spark), rows, 4, group_rows), "fp").collect()
    assert {r.doc_id: r.component_id for r in got} == {ids[i]: low[found[i]] for i in range(len(ids))}


def test_every_pair_is_decided_on_the_trie(monkeypatch):
    """Leaves are single fingerprints reached with the differences of the bits above; every link comes
    from two leaves or from nodes whose bits left cannot exceed the budget; over-budget pairs are
    pruned before their leaves."""
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << x for x in rng.sample(range(40), rng.randint(0, 7))) for b in base for _ in range(12)} | {b ^ (7 << 20) for b in base}
    parts = [(40, 24)]
    fps = np.array(sorted(fps), np.uint64)
    cuts = np.flatnonzero(np.r_[True, fps[1:] >> np.uint64(40) != fps[:-1] >> np.uint64(40)])
    lo, hi = cuts, np.r_[cuts[1:], len(fps)]
    seen = []

    def recorded(fps, a, b, used, rest, budget, plain=simhash.leaf_pairs):
        assert ((np.bitwise_count((fps[a] ^ fps[b]) & ~np.uint64(rest)) == used) & (used <= budget)).all()
        seen.extend(zip(a.tolist(), b.tolist(), strict=True))
        return plain(fps, a, b, used, rest, budget)

    monkeypatch.setattr(simhash, "leaf_pairs", recorded)
    links = {(min(i, j), max(i, j)) for a, b in simhash.trie_links(fps, (lo, hi, lo, hi), simhash.free_bits(parts), 4) for i, j in zip(a.tolist(), b.tolist(), strict=True) if i != j}
    below = {(i, j) for x, y in zip(lo.tolist(), hi.tolist(), strict=True) for i in range(x, y) for j in range(i + 1, y)}
    want = {(i, j) for i, j in below if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4}
    assert links <= want and len(seen) == len(set(seen)) < len(below)
    root = roots(len(fps), links)
    assert all(root[i] == root[j] for i, j in want)


def test_dense_group_links_without_all_pairs():
    fps = np.arange(2048, dtype=np.uint64)  # all differ in the low 11 bits only
    group, side = np.full(len(fps), 0, np.int64), np.zeros(len(fps), np.int64)
    choice = next(n for n, parts in enumerate(simhash.path_keys()) if all(s >= 21 for s, _ in parts))
    a, b = simhash.join_group(fps, group + choice, side)
    assert set(a.tolist()) == set(range(1, 2048)) and set(b.tolist()) == {0}
    spread = sum(len(x) for x, _ in simhash.trie_links(fps, (np.array([0]), np.array([2048]), np.array([0]), np.array([2048])), simhash.free_bits(simhash.path_keys()[choice])))
    assert spread < 2048 * 2047 // 2


def test_keep_one_reads_any_columns(spark):
    rows = [(1, "a b c d e", {"x": 1}, [1]), (1, "a b c d e", {"x": 2}, [2]), (2, "A b c d e", None, None), (3, "other text here", {}, []), (None, "other text here", {}, [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, maybe map<string,int>, bits array<int>")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_simhash_on_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 12
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert len(zero) == 4 and {r.component_id for r in zero} == {1}
    assert {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    assert [r.component_id for r in got if r.doc_id is None and r.fingerprint != "0" * 16] == [None, None]
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == {1: 1, 4: 1, 5: 1, None: 1, 7: 1, 8: 1}
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


# Embeddings.


@pytest.mark.parametrize(("home_rows", "pivots"), [(8192, None), (5, None), (3, 12)])
def test_range_join_matches_all_pairs(spark, home_rows, pivots):
    rng = np.random.default_rng(0)
    data = []
    for _ in range(22):
        c = rng.normal(size=8)
        data += [(c + rng.normal(size=8) * rng.choice([0, 0.2, 0.35])).astype(np.float32).tolist() for _ in range(rng.integers(1, 9))]
    data += [None, [0.0] * 8, [], [float("nan")] * 8, [1.0, None, *[0.0] * 6], [float("inf"), *[1.0] * 7], [1.0, 2.0], [1.0, 2.0, 0.0], [2.0, 4.0]]
    ids = [int(i) for i in rng.permutation(len(data))]
    fine = [x is not None and len(x) > 0 and all(v is not None and np.isfinite(v) for v in x) and any(x) for x in data]
    cos = lambda a, b: np.dot(np.array(a, float), np.array(b, float)) / np.linalg.norm(a) / np.linalg.norm(b)
    links = [(i, j) for i in range(len(data)) for j in range(i) if fine[i] and fine[j] and len(data[i]) == len(data[j]) and cos(data[i], data[j]) >= 0.9]
    found, low = roots(len(data), links), defaultdict(lambda: 10**9)
    for i, r in enumerate(found):
        low[r] = min(low[r], ids[i])
    count = Counter(i for pair in links for i in pair)
    df = spark.createDataFrame([(i, x, 0, 1) for i, x in zip(ids, data, strict=True)], "vec_id long, embedding array<float>, label int, h int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df, home_rows=home_rows, pivots=pivots).collect()}
    assert got == {ids[i]: (count[i], low[found[i]], low[found[i]] == ids[i]) for i in range(len(data))}


def test_range_join_without_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert vectors.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in vectors.near_duplicates(spark.createDataFrame([(4, None), (None, None)], schema)).orderBy("vec_id").collect()] == [(None, 0, None, False), (4, 0, 4, True)]


# Token output.


def test_code_round_trip():
    rng = np.random.default_rng(1)
    for size, n in ((1, 300), (2, 1), (500, 70_000), (40_000, 200_000)):
        ids = (rng.zipf(1.2, n) % size).astype(np.int64)
        values, counts = np.unique(ids, return_counts=True)
        bits = tokens.code_lengths(counts, 19)
        assert bits.max() <= 19 and (2.0 ** -bits.astype(float)).sum() <= 1 + 1e-12
        code = tokens.Code(values, bits)
        cuts = [0, *sorted(rng.integers(0, n, 5).tolist()), n]
        docs = [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        names, sizes, back = tokens.read_segment(code, tokens.write_segment(code, [None, -5, 1, 2, 3, 4], docs))
        assert names == [None, -5, 1, 2, 3, 4] and sizes.tolist() == list(map(len, docs)) and (back == ids).all()
    assert tokens.code_lengths(np.array([1, 1, 2, 4, 8, 16, 32]), 4).max() == 4
    assert tokens.code_lengths(np.array([1, 1, 2, 4, 8]), 16).tolist() == [4, 4, 3, 2, 1]


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.default_tokenizer())
    return [[*e.ids, 2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_chunks_match_library():
    rng = random.Random(3)
    alphabet = "abcXYZ éÉßẞİıſK'’.,!<|>0129٣½ \t\n  \x1c\x85é\x1fñ中文😀_|-"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["a<|endoftext|>b", "it's don't I'LL", "", None]
    encoder = tokens.ChunkEncoder(tokens.tokenizer_file(queries.default_tokenizer()))
    for _ in range(2):
        assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)] == library_ids(texts)


def test_other_tokenizers_encode_whole_texts():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    file = path("byte_bpe_50k.json")
    encoder = tokens.ChunkEncoder(tokens.tokenizer_file(file))
    texts = ["two  blanks here", " leading", None]
    want = [[*e.ids, 2] for e in Tokenizer.from_file(file).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert not encoder.by_word and [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)] == want


def test_steps_of_any_cut_match_library(monkeypatch):
    """Long texts among short ones, caches that overflow, chunks too long to be remembered."""
    monkeypatch.setattr(tokens, "STEP_BYTES", 300)
    monkeypatch.setattr(tokens, "CACHE", 40)
    rng = random.Random(4)
    alphabet = "abÀÖßÿ×÷İKſ'.,!9 \t\n\x1c\x85é\u0301中"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice((0, 5, 40, 299, 300, 2000)))) for _ in range(300)] + [None, "x" * 900, " ", "q" * 70 + " a", None]
    encoder = tokens.ChunkEncoder(tokens.tokenizer_file(queries.default_tokenizer()))
    for _ in range(2):
        assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)] == library_ids(texts)


def test_frequent_words_are_remembered_after_rare_ones(monkeypatch):
    """Words that fill the cache and never return give way to words that do."""
    monkeypatch.setattr(tokens, "CACHE", 400)
    rng = random.Random(5)
    encoder = tokens.ChunkEncoder(tokens.tokenizer_file(queries.default_tokenizer()))
    library, seen = encoder.tokenizer, []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            seen.append(sum(len(t.split()) for t in texts))
            return library.encode_batch_fast(texts, **options)

    def word():
        return "".join(rng.choice(string.ascii_lowercase) for _ in range(9))

    encoder.tokenizer = Counting()
    encoder.encode([" ".join(word() for _ in range(1000))])
    common = [word() for _ in range(100)]
    for _ in range(10):
        text = " ".join([*common, *(word() for _ in range(50))])
        seen.clear()
        got = encoder.encode([text])
        assert [np.frombuffer(x, encoder.dtype).tolist() for x in got] == library_ids([text])
    assert sum(seen) == 50


def test_known_words_cost_no_objects():
    """Encoding words that are known allocates little beyond the texts and ids themselves."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    text = " ".join(rng.choices(vocabulary, k=300_000))
    encoder = tokens.ChunkEncoder(tokens.tokenizer_file(queries.default_tokenizer()))
    encoder.encode([" ".join(vocabulary)])
    tracemalloc.start()
    ids = encoder.encode([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * (len(text) + len(ids[0])), peak


def test_token_index(odd, empty, monkeypatch):
    got = tokens.token_index(odd, queries.default_tokenizer()).orderBy("start").collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0), library_ids([r.text])[0]) for r in odd.collect())
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [k for k, _ in rows]
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((k[1] if k[0] else -1, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for k, i in rows)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert tokens.token_index(empty, queries.default_tokenizer()).count() == 0


# The pipeline against its parts done plainly.


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    """Null ids and texts, repeated rows, and tables whose extra columns have clashing names."""
    import corpus_pipeline

    item = " ".join(f"q{i}" for i in range(12))
    more = spark.createDataFrame([(20, "intro " + item + " outro", "en", "s", 0, "r", 1, 2, 0.5, 3, 4), (21, "kept one " * 30, None, None, 0, "r", 1, 2, 0.5, 3, 4)], odd.schema)
    bench = spark.createDataFrame([(1, item, "x", 1), (2, None, "y", 2)], "item_id long, text string, doc_id string, row int")
    labels = spark.createDataFrame([(1, 0, 1, "t", 5), (5, 0, 0, "t", 5), (8, 0, 0, "t", 5), (4, 0, 0, "t", 5), (None, 1, 1, None, None)], "doc_id long, quality int, toxic int, text string, n int")
    for name, docs in (("odd", odd.unionByName(more)), ("empty", empty)):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        stage_docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            stage_docs = stage(spark, stage_docs, folder)
            assert stage_docs.columns == docs.columns
        got = corpus_pipeline.run(spark, folder).collect()
        if name == "empty":
            assert got == []
            continue
        ids = Counter(r.doc_id for r in got)
        assert 20 not in ids and ids[21] and ids[5] in (1, 2) and [r.start for r in sorted(got, key=lambda r: r.start)] == np.cumsum([0, *(r.n_tokens for r in sorted(got, key=lambda r: r.start))])[:-1].tolist()


def test_pipeline(spark):
    import corpus_pipeline
    from watchloom.llm import decontam, toxicity

    folder = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "benchmark decontamination", "mixing", "token output"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    scores = {r.doc_id: r.score for r in toxicity.score_documents(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    left = [i for i in sorted(rows) if scores[i] < 0.5]
    fps = [slow_fingerprint(rows[i].text) for i in left]
    found = roots(len(left), [(i, j) for i in range(len(left)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    first = {}
    for i, r in zip(left, found, strict=True):
        first.setdefault(r, i)
    left = sorted(first.values())
    index = decontam.Index.of([(r.item_id, decontam.words_of(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
    left = [i for i in left if not any(c / n >= 0.8 for _, n, c, _ in index.hits(rows[i].text))]
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix_documents(docs.where(F.col("doc_id").isin(left))).collect()}
    want = Counter()
    for i, ids in zip(left, library_ids([rows[i].text for i in left]), strict=True):
        if taken[i][1]:
            want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] = taken[i][0] // taken[i][1]
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == +want and len(got) > 50
