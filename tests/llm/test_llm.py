"""Brute-force comparisons and edge cases of the training-data operators."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandlake.llm import chat, exact_dedup, mixing, packing, parsing, quality_rules, queries, sharding, simhash, suffix_trees, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _t string, bucket int"


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(5)
    base = prose(rng, 160)
    texts = [base, base, base + " tail", "x " + base, None, "", "   \n", "a", "ab " * 400, prose(rng, 9000), base[:300] + prose(rng, 80), prose(rng, 30) + base[200:900], "Zz " + base.upper(), "é€ " + prose(rng, 60)]
    rows = [(i, t, "en", "s", None, "clash", 1) for i, t in enumerate(texts)]
    rows += [(3, "x " + base, None, None, 1, None, None), (None, "null id " + base, None, None, 1, None, None), (40, base[:300] + prose(rng, 80), "en", "s", 1, "", 2)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def plain(awkward):
    return [(-(2**63) if r.doc_id is None else r.doc_id, r.text or "") for r in awkward.collect()]


@pytest.fixture(scope="module")
def none(awkward):
    return awkward.limit(0)


def got(df, *cols):
    return sorted(tuple(-(2**63) if v is None and c == "doc_id" else v for c, v in zip(cols, (r[c] for c in cols))) for r in df.collect())


def test_sharding(awkward, none):
    rows = sharding.shard(awkward, 4).collect()
    assert len(rows) == awkward.count() and sharding.shard(none, 4).count() == 0
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {r.law for r in rows} == {"bytes"}
    sizes = lambda rs: sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in rs)
    own = [(r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in awkward.collect()]
    assert sizes(rows) == sorted(own)


def test_sharding_of_next_to_nothing(spark):
    for texts in ([None, ""], ["", ""], ["a"], [None] * 3 + ["b" * 5000]):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        rows = sharding.shard(docs, 8).collect()
        assert len(rows) == len(texts) and {r["size"] for r in rows} == {len(t or "") + 1 for t in texts}
    same = spark.createDataFrame([(7, "same")] * 50 + [(8, "x" * 40)], "doc_id long, text string")
    assert sorted(r.slot for r in sharding.shard(same, 1).collect()) == list(range(51))


def test_sharding_is_even_and_cuts_hot_texts(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, "hot" * 20 if i % 3 == 0 else prose(rng, 20)) for i in range(3000)], "doc_id long, text string")
    rows = sharding.shard(docs, 8).collect()
    size = [sum(r["size"] for r in rows if r.shard == s) for s in range(8)]
    assert max(size) - min(size) <= 0.03 * sum(size) / 8
    own = {r.doc_id: (r["size"], r.text_crc32) for r in rows}
    assert all(own[r.doc_id] == (len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for r in docs.collect())


def test_splitters_stay_within_the_limit(spark):
    rows = sharding.keyed(spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2500, "same").otherwise(F.col("id").cast("string")).alias("text")))
    cuts = sharding.splitters(rows, 40)
    size = [r.b for r in rows.groupBy(sharding.range_of(cuts).alias("r")).agg(F.sum("size").alias("b")).collect()]
    assert max(size) <= 1.5 * sum(size) / 40 + 5


def test_ranges_are_counts_of_smaller_cuts(spark):
    rng = random.Random(3)
    cuts = sorted({(rng.randrange(-4, 4), rng.randrange(-4, 4)) for _ in range(20)})
    keys = [(h, i) for h in range(-5, 6) for i in range(-5, 6)]
    r = spark.createDataFrame(keys, "h long, doc_id long").select("h", "doc_id", sharding.range_of(cuts).alias("r")).collect()
    assert all(x.r == sum(c <= (x.h, x.doc_id) for c in cuts) for x in r)


def test_chat_round_trip(spark):
    texts = ["\\", "###", "</turn>", "\\h", "\\\\e ###</turn>\n### a: b", "", None, "é\n"]
    rows = [(1, k, ("user", "assistant", "a:b\\c")[k % 3], t, 7) for k, t in enumerate(texts)] + [(2, 0, None, "x", 7), (2, 0, "assistant", "y", 7), (None, None, "user", "z", 7)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node int")
    back = {r.tree: r for r in chat.read_back(chat.format_paths(chat.threads(d))).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(r or "", t or "") for _, _, r, t, _ in rows[:8]]
    assert back[1].loss == "".join(t or "" for _, _, r, t, _ in rows[:8] if r == "assistant")
    assert len(back) == 3 and [t.text for t in back[2].turns] == ["x", "y"]
    assert chat.format_paths(chat.threads(d.limit(0))).count() == 0


def test_chat_trees(spark):
    rows = [("t", 0, None, 1), ("t", 1, 0, 5), ("t", 2, 0, 1), ("t", 3, 2, 9), ("t", 4, 3, 1), ("u", 1, 2, 1), ("u", 2, 1, 1), ("u", 3, 1, 1)]
    d = spark.createDataFrame([(t, n, p, "user", f"m{n}", s) for t, n, p, s in rows], "tree string, node long, parent long, role string, text string, score long")
    r = chat.read_back(chat.format_paths(d, best=2)).orderBy("rank").collect()
    assert [[t.text for t in x.turns] for x in r] == [["m0", "m2", "m3", "m4"], ["m0", "m1"]]


def test_exact_dedup(awkward, plain, none):
    strip = str.maketrans("", "", " \t\n\x0b\x0c\r")
    groups = {}
    for i, t in plain:
        groups.setdefault(t.translate(strip), []).append((-len(t), i))
    want = sorted((i, min(g)[1], len(g), i == min(g)[1], hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, i in g)
    for share in (exact_dedup.half_history(), F.lit(True), F.lit(False)):
        r = exact_dedup.exact_dedup(exact_dedup.digests(awkward), share).fillna(-(2**63), ["doc_id", "keep_id"])
        assert got(r, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact_dedup.exact_dedup(exact_dedup.digests(none), F.lit(True)).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 2**63, (5000, 4)).astype(np.uint64)
    levels, slot = exact_dedup.mph_build(keys)
    assert sorted(slot) == list(range(5000)) and (exact_dedup.mph_lookup(levels, keys) == slot).all()


def test_toxicity(spark):
    rng = random.Random(3)
    bad = ["blorgh", "snerkt", "vrimpf"]
    rows, labels = [], []
    for i in range(1200):
        w = prose(rng, 120).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(6):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(toxicity.sample(docs, lab))
    r = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    out = [i for i in r if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in r if r[i].held_out} == set(out)
    assert np.mean([r[i].predicted == labels[i][1] for i in out]) > 0.95
    odd = spark.createDataFrame([(1, None), (None, ""), (1, None)], "doc_id long, text string")
    assert toxicity.score(odd, model).count() == 3 and toxicity.score(odd.limit(0), model).count() == 0
    assert {x.score for x in toxicity.score(odd, toxicity.fit([])).collect()} == {0.5}
    # clashing names, conflicting and null labels, a very long text
    a, b = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    odd = spark.createDataFrame([(a, "x y", 1, "t"), (b, prose(rng, 30_000), 0, "t")], "doc_id long, text string, toxic int, label string")
    lab = spark.createDataFrame([(a, 0), (a, 1), (b, None)], "doc_id long, toxic int")
    assert [(i, y) for i, _, y in toxicity.sample(odd, lab)] == [(a, 1)] and toxicity.score(odd, model).count() == 2


def test_packing(awkward, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(packing.pieces(awkward)).fillna(-(2**63), ["doc_id"]).collect()
    ids = {}
    for r in awkward.collect():
        x = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        ids.setdefault(-(2**63) if r.doc_id is None else r.doc_id, []).append(x)
    want = sorted((i, k // 2048, k, min(2048, len(x) - k), zlib.crc32(x[k : k + 2048].tobytes())) for i, xs in ids.items() for x in xs for k in range(0, len(x), 2048))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(packing.pieces(none)).count() == 0


def test_packing_is_optimal_on_small_cases():
    def fewest(items, cap):
        bins, best = [], [len(items)]

        def go(k):
            if len(bins) >= best[0]:
                return
            if k == len(items):
                best[0] = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + items[k] <= cap:
                    bins[j] += items[k]
                    go(k + 1)
                    bins[j] -= items[k]
            bins.append(items[k])
            go(k + 1)
            bins.pop()

        go(0)
        return best[0]

    rng = random.Random(2)
    for _ in range(150):
        items = sorted((rng.randint(1, 20) for _ in range(9)), reverse=True)
        counts = {s: items.count(s) for s in items}
        fixed, left = packing.reduce_dominated(counts, 20)
        rest = [s for s in sorted(left, reverse=True) for _ in range(left[s])]
        assert sum(n for n, _ in fixed) + (fewest(rest, 20) if rest else 0) == fewest(items, 20)
        back = {}
        for n, content in packing.plan(counts, 20):
            assert sum(s * e for s, e in content) <= 20
            for s, e in content:
                back[s] = back.get(s, 0) + n * e
        assert back == counts


def test_word_encoder_matches_tokenizer():
    from tokenizers import Tokenizer

    e, t = packing.WordEncoder(packing.default_tokenizer()), Tokenizer.from_file(packing.default_tokenizer())
    texts = ["It's  I'LL we've\x1cx\x85y z", "é ́a ΣΑΣ İ", "<|endoftext|> a<|startoftext|>b", "日本語 テスト 123", "a\x00b \t\r\n", ""]
    assert [list(np.frombuffer(x, dtype="<u4")) for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def repeats_by_words(texts):
    first = {}
    words = [(i, t.encode().split()) for i, t in sorted(texts)]
    for i, w in words:
        for k in range(len(w) - 49):
            first[tuple(w[k : k + 50])] = min(i, first.get(tuple(w[k : k + 50]), i))
    want = []
    for i, w in words:
        gone = np.zeros(len(w), dtype=bool)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = True
        want.append((i, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(want)


def repeats_by_bytes(texts):
    seen, want = set(), []
    for i, t in sorted(texts):
        b = t.encode()
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(b[k : k + 100])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(want)


WORD_COLUMNS, BYTE_COLUMNS = ("doc_id", "n_words", "n_removed", "kept_sha256"), ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("hot", [None, 1])
def test_suffix_trees(awkward, plain, none, hot):
    assert got(suffix_trees.remove_repeats(awkward, hot=hot), *WORD_COLUMNS) == repeats_by_words(plain)
    assert suffix_trees.remove_repeats(none).count() == 0


@pytest.mark.parametrize("hot", [None, 1])
def test_parsing(awkward, plain, none, hot):
    assert got(parsing.remove_repeats(awkward, hot=hot), *BYTE_COLUMNS) == repeats_by_bytes(plain)
    assert parsing.remove_repeats(none).count() == 0


@pytest.mark.parametrize("hot", [None, 6])
def test_repeats_in_very_repetitive_texts(spark, hot):
    """A passage in very many texts at every offset, periodic texts, few different letters or words, and texts that one passage begins and ends."""
    rng = random.Random(9)
    passage = prose(rng, 90)
    few = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    texts = [prose(rng, rng.randrange(60)) + " " * rng.randrange(3) + passage[rng.randrange(200) :] + prose(rng, rng.randrange(60)) for _ in range(60)]
    texts += [few(rng.randrange(40, 400)) for _ in range(30)] + ["ab" * 300, "ba" * 200, "a" * 1000, "\0" * 400, "é" * 130, passage, passage * 3]
    texts += [t[rng.randrange(len(t)) :] + rng.choice(texts) for t in texts[:60]]
    docs = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(parsing.remove_repeats(d, hot=hot), *BYTE_COLUMNS) == repeats_by_bytes(docs)
    assert got(suffix_trees.remove_repeats(d, hot=hot), *WORD_COLUMNS) == repeats_by_words(docs)


def test_every_window_has_one_trigger():
    from strandlake.llm import repeats

    rng = random.Random(2)
    import pyarrow as pa

    for modulus in (2, 24, 100_000):
        data = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(700))) for _ in range(9)]
        t = repeats.Texts.of(pa.table({"doc_id": list(range(9)), "text": data}), words=False)
        for a, length, reach in ((parsing.phrases(t, modulus=modulus), 100, 68),):
            owned = [i for lo, hi in zip(a.lo, a.hi) for i in range(lo, hi + 1)]
            assert sorted(owned) == [int(t.byte[k]) + i for k, x in enumerate(data) for i in range(len(x) - length + 1)]
            assert (a.at - a.lo <= reach).all() and (a.hi <= a.at).all()


def fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    shingles = [b" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    ones = [sum(xxhash.xxh64_intdigest(s, seed=42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles)) if shingles else 0


def components(nodes):
    """nodes: (id, fingerprint) -> smallest id reachable over links of 4 bits."""
    root = list(range(len(nodes)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(nodes)):
        for b in range(a):
            if (nodes[a][1] ^ nodes[b][1]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(nodes):
        least[find(k)] = min(i, least.get(find(k), i))
    return [least[find(k)] for k in range(len(nodes))]


def test_simhash(awkward, plain, none):
    nodes = [(i, fingerprint(t)) for i, t in plain]
    want = sorted((i, format(f, "016x"), c) for (i, f), c in zip(nodes, components(nodes)))
    r = simhash.near_duplicates(awkward).fillna(-(2**63), ["doc_id", "component_id"])
    assert got(r, "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("hot", [8000, 20])
def test_trie_links(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(4)
    keys = {rng.getrandbits(64) for _ in range(150)}
    for _ in range(350):
        keys.add(rng.choice(sorted(keys)[:20]) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) & (2**64 - 1))
    nodes = [(k, f) for k, f in enumerate(sorted(keys))]
    signed = [(f - (1 << 64) if f >= 1 << 63 else f,) for _, f in nodes]
    from strandlake.llm.components import connected_components

    links = simhash.links(spark.createDataFrame(signed, "fp long"), len(signed))
    root = {r.node: r.root for r in connected_components(links).collect()}
    own = [root.get(s[0], s[0]) for s in signed]
    want = components(nodes)
    assert len(set(zip(own, want))) == len(set(own)) == len(set(want))


def test_components_of_a_path_and_a_star(spark):
    from strandlake.llm.components import connected_components

    edges = [(k, k + 1) for k in range(60)] + [(1000, 2000 + k) for k in range(50)] + [(5, 5)]
    r = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {r[k] for k in range(61)} == {0} and {r[k] for k in r if k >= 1000} == {1000}


def test_quality_rules(awkward, none):
    import re

    led = quality_rules.apply_policy(quality_rules.ledger(awkward.withColumn("doc_id", F.monotonically_increasing_id()))).collect()
    texts = [r.text for r in awkward.withColumn("doc_id", F.monotonically_increasing_id()).orderBy("doc_id").collect()]
    for r, t in zip(sorted(led, key=lambda r: r.doc_id), texts, strict=True):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        grams = {}
        for k in range(len(w) - 7):
            grams.setdefault(tuple(w[k : k + 8]), []).append(k)
        cover = {p for ks in grams.values() if len(ks) > 1 for k in ks for p in range(k, k + 8)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(cover))
        assert r.kept == brute_quality(t)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    assert quality_rules.ledger(none).count() == 0
    kept = quality_rules.passing(awkward)
    assert kept.columns == awkward.columns and kept.count() == sum(r.kept for r in led)
    a = {x.rule: x for x in quality_rules.ablations(quality_rules.ledger(awkward)).collect()}
    for rule, bit in quality_rules.BIT.items():
        bits = [r.failure_bits for r in led]
        assert (a[rule].n_failed, a[rule].n_only, a[rule].n_kept_without) == (sum(b & bit > 0 for b in bits), sum(b == bit for b in bits), sum(b & ~bit == 0 for b in bits))


def test_mixing_meets_its_targets(spark, none):
    rng = random.Random(6)
    rows = [(i, prose(rng, 40), rng.choice(["en", "de"]), rng.choice(["a", "a", "a", "b", "c"])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    r = mixing.mix(docs, {"source": {"a": 1, "b": 1, "c": 1}, "lang": {"en": 3, "de": 1}}, budget=0.3).toPandas()
    drawn = (r.n_tokens * r.probability).groupby(r.source).sum()
    assert np.allclose(drawn / drawn.sum(), 1 / 3, atol=0.01)
    lang = (r.n_tokens * r.probability).groupby(r.lang).sum()
    assert abs(lang["en"] / lang.sum() - 0.75) < 0.01
    assert abs(r.selected.mean() - r.probability.mean()) < 0.05
    assert mixing.mix(none).count() == 0


def test_mixing_awkward(awkward):
    rows = mixing.mix(awkward).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.source or "", r.lang or "") for r in rows) == sorted((r.doc_id is None, r.doc_id or 0, r.source or "", r.lang or "") for r in awkward.collect())
    assert all(0 <= r.probability <= 1 for r in rows)
    assert mixing.sampled(awkward).columns == awkward.columns


def test_mixing_without_tokens(spark):
    docs = spark.createDataFrame([(1, None, "en", "s"), (2, "", None, "s"), (2, " ", None, None)], "doc_id long, text string, lang string, source string")
    assert {(r.probability, r.selected) for r in mixing.mix(docs).collect()} == {(1.0, True)}


def test_mixing_shares_what_a_used_up_value_leaves(spark):
    rows = [(i, prose(random.Random(i), 20), "en" if i % 3 else "de", "small" if i < 30 else "big" if i < 800 else "other") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    cells = mixing.cells_of(docs.select("source", "lang", mixing.topic_of(F.col("text")).alias("topic"), mixing.n_tokens(F.col("text")).alias("n_tokens")))
    raked = mixing.rake(cells, {"source": {"small": 1, "big": 1, "other": 1}, "lang": 0.7, "topic": 0.7}, 0.5)
    r = {(x.dimension, x.value): x for x in mixing.residuals(raked).collect()}
    assert max(abs(x.residual) for x in r.values()) <= mixing.TOLERANCE
    assert [round(r["source", s].target) for s in ("small", "big", "other")] == [600, 5700, 5700]
    for d in mixing.DIMENSIONS:
        assert abs(sum(x.drawn for k, x in r.items() if k[0] == d) - 12000) < 20


def test_queries_mixing_meets_targets_on_whole_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cells = mixing.cells_of(docs.select("source", "lang", mixing.topic_of(F.col("text")).alias("topic"), mixing.n_tokens(F.col("text")).alias("n_tokens")))
    raked = mixing.rake(cells, dict.fromkeys(mixing.DIMENSIONS, mixing.TEMPERATURE))
    assert mixing.residuals(raked).agg(F.max(F.abs("residual"))).first()[0] <= mixing.TOLERANCE


def test_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        a, b = queries.QUERIES[name](spark, sf).toPandas(), con.sql(sql).df()
        cols = sorted(a.columns)
        assert cols == sorted(b.columns), name
        key = lambda df: sorted(tuple(map(str, r)) for r in df[cols].itertuples(index=False))  # noqa: B023,E731
        assert key(a) == key(b), name


def brute_quality(text):
    import re

    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    grams = {}
    for k in range(len(w) - 7):
        grams.setdefault(tuple(w[k : k + 8]), []).append(k)
    cover = {p for ks in grams.values() if len(ks) > 1 for k in ks for p in range(k, k + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars, symbols = sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>")
    return not (len(w) < 20 or 100 * len(cover) > 30 * len(w) or symbols > len(w) or 10 * (len(lines) - len(set(lines))) > 6 * len(lines) or chars < 2 * len(w) or chars > 25 * len(w))


def brute_near(rows):
    """Of rows (id, text) the smallest id of each group linked by a Jaccard similarity of 0.8 of five-word shingles."""
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if root[a] != root[b] and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    best = {}
    for k, row in enumerate(rows):
        best[root[k]] = min(best.get(root[k], row), row)
    return sorted(best.values())


def brute_mix(rows):
    """Rows (id, text, lang, source) drawn by raking in numpy."""
    many = lambda t, c: sum(map(t.count, c)) > len(t) / 50
    topic = lambda t: "markup" if many(t, "|#*$%&") else "exclaimed" if many(t, "!?") else "numeric" if many(t, "0123456789") else "prose"
    cell = [(s, g, topic(t)) for _, t, g, s in rows]
    held = {}
    for c, r in zip(cell, rows):
        held[c] = held.get(c, 0) + len(r[1].encode().split())
    cells, tokens = list(held), np.array(list(held.values()), dtype=float)
    goal = []
    for d in range(3):
        values = sorted({c[d] for c in cells}, key=str)
        own = np.array([[c[d] == v for c in cells] for v in values])
        h = own @ tokens
        w = (h / tokens.sum()) ** mixing.TEMPERATURE
        lo, hi = 0.0, 1e12
        for _ in range(300):  # the level at which the targets, none above what is held, add up to the budget
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.minimum(h, w * mid).sum() < mixing.BUDGET * tokens.sum() else (lo, mid)
        goal.append((own, np.minimum(h, w * hi)))
    x = mixing.BUDGET * tokens
    for k in range(mixing.MOST_ROUNDS):
        for own, t in goal:
            x = np.minimum(tokens, x * (own.T @ (t / np.maximum(own @ x, 1e-300))))
        if k % mixing.ROUNDS_PER_STEP == mixing.ROUNDS_PER_STEP - 1 and max(np.abs(own @ x / t - 1).max() for own, t in goal) <= mixing.TOLERANCE:
            break
    rate = dict(zip(cells, x / tokens))
    draw = lambda i: int(hashlib.md5(f"{'' if i is None else i}:mix".encode()).hexdigest()[:8], 16) / 2**32
    return [r for c, r in zip(cell, rows) if draw(r[0]) < rate[c]]


def brute_pipeline(rows):
    """The pieces that the pipeline packs, from rows (id, text, lang, source)."""
    from tokenizers import Tokenizer

    low = lambda i: -(2**63) if i is None else i
    rows = [r for r in rows if brute_quality(r[1])]
    best = {}
    for r in rows:
        key = r[1].translate(str.maketrans("", "", " \t\n\x0b\x0c\r"))
        if key not in best or (-len(r[1]), low(r[0])) < (-len(best[key][1]), low(best[key][0])):
            best[key] = r
    own = {(low(r[0]), r[1]): r for r in best.values()}
    rows = brute_mix([own[k] for k in brute_near(sorted(own))])
    t, out = Tokenizer.from_file(packing.default_tokenizer()), []
    for i, text, *_ in rows:
        x = np.array(t.encode(text, add_special_tokens=False).ids + [0], dtype="<u4")
        out += [(low(i), k // 2048, k, min(2048, len(x) - k), zlib.crc32(x[k : k + 2048].tobytes())) for k in range(0, len(x), 2048)]
    return sorted(out)


def packed(rows):
    """The pieces of a packing, once their places are seen to be gapless."""
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    return sorted((-(2**63) if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = brute_pipeline([(r.doc_id, r.text, r.lang, r.source) for r in docs])
    assert want and packed(corpus_pipeline.run(spark, sf).collect()) == want


def test_pipeline_stages_on_awkward_rows(spark, awkward, none):
    import corpus_pipeline

    rng = random.Random(12)
    more = [(100 + k, prose(rng, 150), "en" if k % 2 else None, "t", None, None, None) for k in range(12)]
    docs = awkward.unionByName(spark.createDataFrame(more, SCHEMA))
    want = brute_pipeline([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        nothing = stage(spark, none, "")
        assert nothing.count() == 0 and (k == 4 or nothing.columns == awkward.columns)
        docs = stage(spark, docs, "")
    assert want and packed(docs.collect()) == want


def test_near_stage_finds_all_pairs_of_similar_texts(spark, monkeypatch):
    import corpus_pipeline
    from strandlake.llm import near_copies

    monkeypatch.setattr(near_copies, "HOT_KEY", 20)
    monkeypatch.setattr(near_copies, "HOT_COMPONENT", 20)
    rng = random.Random(8)
    rows, base = [], [prose(rng, 200).split() for _ in range(40)]
    for i in range(300):
        w = list(base[i % 40 if i < 200 else 7])  # one large group
        for _ in range(rng.randrange(12)):
            w[rng.randrange(200)] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    root, far = list(range(300)), 0
    for a in range(300):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                far += (fingerprint(rows[a][1]) ^ fingerprint(rows[b][1])).bit_count() > 4
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect())
    assert far > 100 and kept == [i for i in range(300) if root[i] == i]


def test_dedup_stages_keep_one_row_of_each_group(spark):
    import corpus_pipeline

    rng = random.Random(3)
    a, b, c, d = (prose(rng, 100) for _ in range(4))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = lambda *x: spark.createDataFrame([(i, t, "en", "s", 1) for i, t in x], schema)
    order = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    # null ids, an id of two different texts, repeated rows
    docs = rows((None, a), (1, a), (2, b), (3, b), (3, c), (4, d), (4, d), (None, d))
    assert order(corpus_pipeline.exact(spark, docs, "")) == sorted([(None, a), (2, b), (3, c), (None, d)], key=str)
    docs = rows((None, a), (1, a + " x"), (2, b), (3, b + " y"), (3, c), (4, d), (4, d), (5, d + " z"))
    assert order(corpus_pipeline.near(spark, docs, "")) == sorted([(None, a), (2, b), (3, c), (4, d)], key=str)


def test_toxic_stems_of_a_small_language_rank_early():
    rng = random.Random(6)
    rows = []
    for i in range(2400):
        small, toxic = i % 12 == 0, rng.random() < 0.15
        if small:
            w = [rng.choice("uno dos tres casa perro gato".split()) + rng.choice(["", "s"]) for _ in range(40)]
            bad = ["bomentevil", "malditoso"]
        else:
            w = [rng.choice("one two three house dog cat bird tree".split()) + rng.choice(["", "s"]) for _ in range(40)]
            bad = [f"{c}{c}wicked" for c in "abcdefghijklmnopqrst"]
        if toxic:
            w[5:5] = rng.sample(bad, 1 if small else 6)
        rows.append((" " + " ".join(w) + " ").encode() + (b"!" if toxic else b""))
    toxic, ordinary = ([r.rstrip(b"!") for r in rows if r.endswith(b"!") == y] for y in (True, False))
    stems = toxicity.ranked_stems(toxic, ordinary, toxicity.vocabulary_groups(toxic + ordinary))
    assert {b"bomentevil", b"malditoso"} <= set(stems[:10])
