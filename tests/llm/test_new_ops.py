"""Operators 11 to 13 and texts of NUL bytes, against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import chat, filter_audit, parsing, pii, pii_examples, queries, suffix_trees, whitening

DOCS = "doc_id long, text string, source string, digest string, n int, _t string"


def plain_base(text):
    """The contract's patterns, as they are."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for rank, (kind, p) in enumerate(patterns.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and pii_examples.luhn(digits or "1"), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_base_spans_of_random_texts():
    rng = random.Random(3)
    for alphabet in ("a@.-1", "0123456789 -", "+12 ().-3", "1.2 25", "é@a.b_%9 "):
        for _ in range(400):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
            assert pii.base_spans(text) == plain_base(text), text
    long = "a" * 200_000 + "@b.c " + "1" * 200_000 + " +1" + " " * 200_000 + "2.2.2.2"
    assert [s[0] for s in pii.base_spans(long)] == ["email", "ip"]


def test_viterbi_finds_the_best_of_all_labellings():
    rng = np.random.default_rng(4)
    n = pii.OUT + 1
    rule, begin = pii._allowed()
    field = pii.Field(rng.normal(size=(6, n)), rng.normal(size=(n, n)) + rule, rng.normal(size=n) + begin)
    rows, chain = rng.integers(0, 6, (9, 2)), np.array([0, 0, 0, 1, 2, 2, 3, 3, 3])
    got = pii.viterbi(field, rows, chain)
    emit = field.weight[rows].sum(axis=1)
    for c in range(4):
        at = np.flatnonzero(chain == c)
        score = lambda y: field.start[y[0]] + sum(emit[i, v] for i, v in zip(at, y)) + sum(field.step[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        assert tuple(got[at]) == max(itertools.product(range(n), repeat=len(at)), key=score)


def test_field_generalises_to_lines_it_has_not_seen():
    parsed = [pii_examples.parsed(line) for line in pii_examples.LINES]
    rng = np.random.default_rng(1)
    seen = [x for i, x in enumerate(parsed) if i % 3]
    field = pii.train(seen + [pii_examples.varied(*x, rng) for x in seen for _ in range(3)])
    held = [x for i, x in enumerate(parsed) if i % 3 == 0]
    found = pii.added_spans(field, [t for t, _ in held], [[] for _ in held])
    right = sum(len(set(s) & set(f)) for (_, s), f in zip(held, found, strict=True))
    assert sum(map(len, found)) - right <= 1 and right >= 0.6 * sum(len(s) for _, s in held)


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice(["Alpha", "beta", "g", "DELTA", "x#"]) + rng.choice(["", "", "1"]) for _ in range(n))
    texts = [None, "", " \n", "call (415) 555-0199 now", "a.b@c.de +1 (212) 555-0143", "4111 1111 1111 1111", words(250), words(3), "é" * 300, "unique " * 300, " ".join(f"w{i}" for i in range(400)), "mail käthe@bücher.example ok", words(20_000)]
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, "clash", 1, "clash") for i, t in enumerate(texts)]
    rows += [(i + 20, t, f"s{i % 3}", None, 2, None) for i, t in enumerate(texts)] + [(20, None, "s1", None, 2, None), (None, texts[6], "s1", None, 2, None), (3, texts[3], "s1", "", 2, "")]
    return spark.createDataFrame(rows, DOCS)


def test_pii(awkward):
    rows = pii.find_pii(awkward).collect()
    assert len(rows) == awkward.count() and pii.find_pii(awkward.limit(0)).count() == 0
    want = Counter()
    for r in awkward.collect():
        spans = plain_base(r.text or "")
        kinds = Counter(k for k, _, _ in spans)
        want[(r.doc_id, *(kinds[k] for k in pii.KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == want
    spans = {r.doc_id: r.spans for r in rows}
    assert spans[3] == "phone:5:19" and spans[4] == "email:0:8,phone:9:26" and spans[5] == "card:0:19" and spans[11] == "email:5:25" and spans[10] == spans[0] == ""


def brute_audit(docs, labels):
    texts = [(d.doc_id, d.source or "", d.text or "") for d in docs]
    least, good, toxic = {}, {}, {}
    for i, _, t in texts:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    for r in labels:
        good[r.doc_id] = good.get(r.doc_id, False) or r.quality == 1
        toxic[r.doc_id] = toxic.get(r.doc_id, False) or r.toxic == 1
    out = Counter()
    for i, part, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                key = (part, "".join(order), step)
                hit = fails[f] and not gone
                for name, v in (("kept", not gone and not fails[f]), ("removed", hit), ("redundant", gone and fails[f]), ("unique_fails", fails[f] and sum(fails.values()) == 1), ("good_lost", hit and good.get(i)), ("toxic_lost", hit and toxic.get(i))):
                    out[(*key, name)] += bool(v) if i is not None or name not in ("good_lost", "toxic_lost") else 0
                out[(part, f, "shapley")] += hit
                gone |= hit
    return out


def test_filter_audit(spark, awkward):
    labels = spark.createDataFrame([(6, 1, 0), (6, 0, 1), (7, 1, None), (26, 0, 1), (None, 1, 1), (27, 1, 1), (3, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    want = brute_audit(awkward.collect(), labels.collect())
    rows = filter_audit.filter_audit(awkward, labels).collect()
    assert len(rows) == 4 * 600 and filter_audit.filter_audit(awkward.limit(0), labels).count() == 0
    for r in rows:
        for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[name] == want[(r.part, r.filter_order, r.step, name)], (r, name)
        assert r.shapley == want[(r.part, r.filter_order[r.step - 1], "shapley")]


def brute_whitening(vectors, most=32):
    c = np.array(vectors, dtype=np.float64)
    x = np.array([[floor(64 * v) + 1_000_000 for v in row] for row in c.tolist()], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((x * n - s) ** 2).sum(axis=1)
    y = np.array((x * n - s), dtype=np.float64) / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    kept = e[:most] > 1e-13 * e[0]
    return deviation, y @ (q[:, :most][:, kept] / np.sqrt(e[:most][kept])), e[:most][kept] / e.sum()


@pytest.mark.parametrize("d", [3, 24, 90])
def test_whitening(spark, d):
    rng = np.random.default_rng(d)
    base = (rng.standard_normal((150, d)) * np.linspace(3, 0.3, d)).astype(np.float32)
    if d == 24:
        base[:, 7] = base[:, 3]  # a direction without variance
    good = [(i, v.tolist()) for i, v in enumerate(base)] + [(5, base[5].tolist()), (None, base[9].tolist())]
    bad = [(500, None), (501, [None] + base[0].tolist()[1:]), (502, [float("nan")] + base[0].tolist()[1:]), (503, [float("inf")] + base[0].tolist()[1:]), (504, base[0].tolist()[1:]), (505, [])]
    rows = spark.createDataFrame([(*r, 0, "x") for r in good + bad], "vec_id long, embedding array<float>, n int, component string").repartition(5)
    deviation, z, share = brute_whitening([v for _, v in good])
    got = whitening.whiten(rows).toPandas()
    k = z.shape[1]
    assert len(got) == len(good) * k and set(got["n"]) == {len(good)} and got["identity_error"].iloc[0] < 1e-10
    for i in (0, 77, 149):
        own = got[got["vec_id"] == i].sort_values("component")
        assert list(own["component"]) == list(range(1, k + 1)) and set(own["deviation"]) == {deviation[i]}
        assert np.allclose(np.abs(own["whitened"]), np.abs(z[i]), atol=1e-9) and np.allclose(own["explained"], share, rtol=1e-9)
    wide = got.drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened")
    sign = np.sign(wide.loc[0].to_numpy() * z[0])
    assert np.allclose(wide.loc[[*range(150)]].to_numpy() * sign, z[:150], atol=1e-8)


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    huge = whitening.whiten(spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 0.5])], schema)).collect()
    assert {(r.vec_id, r.deviation) for r in huge} == {(1, None), (2, None), (3, 16384)}


def test_repeats_among_nul_bytes(spark):
    rng = random.Random(8)
    t = "".join(rng.choice("abcdefgh ") for _ in range(120))
    six = ["q" + "\0" * 40 + t[:90], t[:90] + "zz" * 20, "w" + "\0" * 40 + t[:90], "\0" * 20 + t[:90], "e" + "\0" * 40 + t[:90], "\0" * 40 + t[:90]]
    few = ["".join(rng.choice("\0\0\0ab") for _ in range(rng.randrange(60, 400))) for _ in range(6)]
    few += [few[i % 6][rng.randrange(40) :] + "\0" * rng.randrange(90) for i in range(12)]
    for texts in (six, few):
        seen, want = set(), {}
        for i, x in enumerate(texts):
            b, gone = x.encode(), np.zeros(len(x), bool)
            for at in range(len(b) - 99):
                if b[at : at + 100] in seen:
                    gone[at : at + 100] = True
                seen.add(b[at : at + 100])
            want[i] = (int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
        for hot in (None, 3):
            rows = parsing.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), hot=hot).collect()
            assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in rows} == want


def test_queries_read_their_tables(spark, sf):
    assert queries.op11_pii(spark, sf).where(F.length("spans") > 0).count() > 0
    assert queries.op12_whitening(spark, sf).agg(F.max("identity_error")).first()[0] < 1e-4
    assert queries.op13_filter_audit(spark, sf).count() % 600 == 0


def test_deep_trees_are_ranked_before_they_are_spelled_out(spark, monkeypatch):
    rng = random.Random(12)
    comb = [("comb", i, i - 1 if i else None, "user", f"t{i}", 1) for i in range(400)] + [("comb", 1000 + i, i, "assistant", f"leaf{i}", rng.randrange(900)) for i in range(400)]
    trees = [(t, i, rng.randrange(i) if i else None, rng.choice(["user", "assistant"]), f"{t}-{i}", rng.randrange(-3, 9)) for t in ("a", "b", None) for i in range(60)]
    trees += [("loop", 0, 1, "user", "x", 1), ("loop", 1, 0, "user", "y", 1), ("loop", 2, 1, "user", "z", 1), ("loop", 3, 99, "user", "own root", 1)]
    written = []

    def counting(df, *by):
        out = chat_materialize(df, *by)
        written.append(out.count())
        return out

    chat_materialize = chat.materialize
    monkeypatch.setattr(chat, "materialize", counting)
    rows = comb + trees
    got = chat.read_back(chat.format_paths(spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score long"), best=3)).collect()
    assert max(written) <= 2 * len(rows) + 3 * 800
    by_tree = {}
    for r in rows:
        by_tree.setdefault(r[0], {})[r[1]] = r
    for tree, nodes in by_tree.items():
        parents, found = {r[2] for r in nodes.values()}, []
        for leaf in nodes.keys() - parents:
            path, at = [], leaf
            while at in nodes and len(path) <= len(nodes):
                path.append(nodes[at])
                at = nodes[at][2]
            if len(path) <= len(nodes):
                found.append((-sum(r[5] for r in path), leaf, [(r[3], r[4]) for r in reversed(path)]))
        want = [(-s, leaf, turns) for s, leaf, turns in sorted(found)[:3]]
        own = sorted((r for r in got if r.tree == tree), key=lambda r: r["rank"])
        assert [(r.score, r.leaf, [(t.role, t.text) for t in r.turns]) for r in own] == want


def test_parse_order_against_brute_force():
    """Groups of random surroundings over few letters, NUL among them, whose parses hold one phrase to many."""
    rng = random.Random(1)
    for _ in range(300):
        window, gram = rng.choice([12, 20]), rng.choice([2, 4])
        reach, letters = window - gram, rng.choice([b"ab", b"\0a", b"abc", b"\0"])
        base = [bytes(rng.choice(letters) for _ in range(reach + window)) for _ in range(rng.randrange(1, 4))]
        rows, left, right = np.zeros((rng.randrange(2, 40), reach + window), np.uint8), [], []
        for row in rows:
            s = bytearray(rng.choice(base))
            for _ in range(rng.randrange(3)):
                s[rng.randrange(len(s))] = rng.choice(letters)
            left.append(rng.randrange(reach + 1))
            right.append(rng.randrange(max(gram, window - left[-1]), window + 1))
            row[reach - left[-1] : reach + right[-1]] = np.frombuffer(bytes(s), np.uint8)[reach - left[-1] : reach + right[-1]]
        seen, want = set(), np.zeros((len(rows), reach + 1), bool)
        for i, row in enumerate(rows):
            for x in range(max(0, window - right[i]), left[i] + 1):
                found = (x, row[reach - x : reach - x + window].tobytes())
                want[i, x] = found in seen
                seen.add(found)
        got = parsing.combined_order(rows, np.array(left, np.int32), np.array(right, np.int32), np.arange(len(rows)), window, gram, rng.choice([2, 3, 24]))
        assert (got == want).all()


def test_phrases_with_one_digest_are_told_by_their_bytes(monkeypatch):
    data = np.frombuffer(b"abcabdab", np.uint8)
    start, end = np.array([0, 3, 6]), np.array([3, 6, 8])
    assert [v.tolist() for v in parsing.dictionary(data, start, end)] == [[0, 1, 2], [0, 1, 2]]
    monkeypatch.setattr(parsing, "spans_hash", lambda data, start, end: np.zeros(len(start), np.uint64))
    assert [v.tolist() for v in parsing.dictionary(data, start, end)] == [[0, 1, 2], [0, 1, 2]]


def test_internal_nodes():
    nodes = suffix_trees.internal_nodes(np.array([-1, 3, 5, 5, 2, -1, 0, 4]), 2)
    assert sorted(zip(*(v.tolist() for v in nodes))) == [(0, 4, 3), (0, 5, 2), (1, 4, 5), (6, 8, 4)]


@pytest.mark.parametrize("at_once", [1, 7, 1 << 17])
def test_deep_nodes_against_brute_force(monkeypatch, at_once):
    """Groups of random surroundings over few words, nested repeats and repeated documents among them, in batches of any size."""
    monkeypatch.setattr(suffix_trees, "AT_ONCE", at_once)
    rng = random.Random(2)
    for _ in range(150):
        window, prefix = rng.choice([(6, 2), (12, 3), (9, 8)])
        reach, words = window - prefix, rng.choice([[0, 7], [1, 2], [0], [256, 1, 1 << 40]])
        base = [[rng.choice(words) for _ in range(reach + window)] for _ in range(rng.randrange(1, 4))]
        rows, left, right = np.zeros((rng.randrange(2, 40), reach + window), np.uint64), [], []
        for row in rows:
            s = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                s[rng.randrange(len(s))] = rng.choice(words)
            left.append(rng.randrange(reach + 1))
            right.append(rng.randrange(max(prefix, window - left[-1]), window + 1))
            row[reach - left[-1] : reach + right[-1]] = s[reach - left[-1] : reach + right[-1]]
        doc = np.sort([rng.randrange(len(rows)) for _ in rows])
        smallest, want = {}, np.zeros((len(rows), reach + 1), bool)
        for i, row in enumerate(rows):
            for x in range(max(0, window - right[i]), left[i] + 1):
                want[i, x] = smallest.setdefault((x, row[reach - x : reach - x + window].tobytes()), doc[i]) != doc[i]
        assert (suffix_trees.deep_nodes(rows, np.array(left, np.int32), np.array(right, np.int32), doc, window) == want).all()
