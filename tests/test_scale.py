"""Super-k-mers, stored sets, tiles, distributed ranks and resumed runs against brute force."""

import gzip
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandlake.functions import permutation, stats
from strandlake.operators import binning, classifier, kmer_sets, nonb, nullomers, superkmers, tfbs, tiled
from strandlake.sources import files, resume, tiles


def brute_counts(seqs, k, canonical):
    out = Counter()
    for key, s in seqs:
        for i in range(len(s or "") - k + 1):
            w = s[i : i + k]
            if set(w) <= set("ACGT"):
                rc = w[::-1].translate(str.maketrans("ACGT", "TGCA"))
                w = min(w, rc) if canonical else w
                out[key, int(w.translate(str.maketrans("ACGT", "0123")), 4)] += 1
    return out


@pytest.fixture(scope="module")
def odd_seqs(spark):
    rng = random.Random(2)
    dna = lambda n, letters="ACGT": "".join(rng.choice(letters) for _ in range(n))
    texts = [None, "", "AC", "A" * 700, "ACGT" * 100, dna(900), dna(400, "ACGTN"), "N" * 50, dna(300, "AC"), dna(5)] + [dna(rng.randrange(200), "ACGTTTN") for _ in range(30)]
    return [(f"p{i % 7}" if i % 9 else None, "orig" if i % 3 else "syn", t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("k", [1, 5, 12, 31])
@pytest.mark.parametrize("part_letters", [60, 1 << 20])
def test_superkmer_counts(spark, odd_seqs, k, part_letters):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        df = spark.createDataFrame(odd_seqs, "pair_id string, which string, seq string").repartition(3)
        for canonical in (False, True):
            want = brute_counts([(p, s) for p, _, s in odd_seqs], k, canonical)
            got = superkmers.counts(df, k, "pair_id", canonical=canonical, part_letters=part_letters).collect()
            assert len(got) == len(want) and {(r.pair_id, r.code): r.n for r in got} == want
        every = superkmers.counts(df, k, part_letters=part_letters).collect()
        assert len(every) == len({r.code for r in every}) and sum(r.n for r in every) == sum(brute_counts([(0, s) for *_, s in odd_seqs], k, False).values())
        sides = brute_counts([((p, w), s) for p, w, s in odd_seqs], k, False)
        joint = Counter()
        for p, code in {(p, code) for (p, _), code in sides}:
            joint[p, sides[(p, "orig"), code], sides[(p, "syn"), code]] += 1
        got = superkmers.joint_spectrum(df, k, part_letters=part_letters).collect()
        assert {(r.pair_id, r.orig, r.syn): r.n for r in got} == joint
        spec = superkmers.spectra(df, k, "pair_id", part_letters=part_letters).collect()
        assert {(r.pair_id, r.x): r.n_x for r in spec} == Counter((p, n) for (p, _), n in brute_counts([(p, s) for p, _, s in odd_seqs], k, False).items())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_superkmers_send_less_than_the_letters(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, "".join(rng.choice("ACGT") for _ in range(5000))) for i in range(20)], "i int, seq string")
    for k, part_letters, most in ((6, 1 << 20, 0.3), (15, 4000, 1.05), (31, 4000, 1.0)):
        cut = superkmers.split(df, k, part_letters=part_letters)
        sent = cut.agg(F.sum(F.length("_letters") + F.length("_runs"))).first()[0]
        assert sent < most * 100_000, (k, sent)


def test_stored_sets_merge_without_a_shuffle(spark, odd_seqs):
    df = spark.createDataFrame(odd_seqs, "pair_id string, which string, seq string").where("pair_id IS NOT NULL")
    sets = kmer_sets.write(df, [3, 5], "sets_of_test", "pair_id", "which", buckets=4)
    try:
        for k in (3, 5):
            want = {tuple(r) for r in nullomers.pair_metrics(nullomers.presence(df, k)).collect()}
            assert {(r[0], *r[2:]) for r in kmer_sets.pair_metrics(sets).where(F.col("k") == k).collect()} == want
        one, other = (sets.where((F.col("pair_id") == p) & (F.col("which") == "orig")) for p in ("p1", "p5"))
        plans = [kmer_sets.presence(sets), *(kmer_sets.merged(one, other, k, how) for how in ("inner", "left_anti") for k in (3, 5))]
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for p in plans:
            assert "Exchange" not in p._jdf.queryExecution().executedPlan().toString()
        for k, shared, own in zip((3, 5), plans[1:3], plans[3:], strict=True):
            a, b = ({c for _, c in brute_counts([(0, s) for p, w, s in odd_seqs if p == q and w == "orig"], k, True)} for q in ("p1", "p5"))
            assert {r.code for r in shared.collect()} == a & b and {r.code for r in own.collect()} == a - b
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        kmer_sets.drop(spark, "sets_of_test")


def dna_of(rng, n, rich=True):
    """Random letters with runs, alternations, repeats and their reverses."""
    pick = lambda m, letters="ACGT": "".join(rng.choice(letters) for _ in range(m))
    out = ""
    while len(out) < n:
        kind = rng.random() if rich else 0
        if kind < 0.3 or len(out) < 80:
            out += pick(rng.randrange(1, 60))
        elif kind < 0.5:
            out += pick(rng.randrange(1, 10)) * rng.randrange(9)
        elif kind < 0.65:
            out += rng.choice(["CG", "GC", "CA", "TG"]) * rng.randrange(40)
        elif kind < 0.72:
            out += rng.choice("ACGTN") * rng.randrange(30)
        elif kind < 0.85:
            at = rng.randrange(len(out) - 60)
            w = out[at : at + rng.randrange(8, 60)]
            out += pick(rng.randrange(12)) + rng.choice([w, w[::-1], w[::-1].translate(str.maketrans("ACGT", "TGCA"))])
        else:
            out += pick(rng.randrange(60), "CGGGA")
    return out[:n]


def brute_repeats(s, most_arm):
    """All repeats by their definitions: each shift, each centre, letter by letter."""
    n, out = len(s), set()
    rc = str.maketrans("ACGT", "TGCA")
    for shift in range(1, min(n, most_arm + 11)):
        i = 0
        while i + shift < n:
            j = i
            while j + shift < n and s[j] == s[j + shift] != "N":
                j += 1
            if shift <= 9 and j - i + shift >= max(10, 3 * shift) and not any(shift % u == 0 and s[i : i + u] * (shift // u) == s[i : i + shift] for u in range(1, shift)):
                out.add(("STR", i, j + shift, shift))
            arm = min(j - i, shift, most_arm)
            if arm >= 10 and shift - arm <= 10:
                out.add(("DR", i, i + shift + arm, arm))
            i = j + 1
    for name, least, pair in (("IR", 6, lambda a, b: a != "N" and a.translate(rc) == b), ("MR", 10, lambda a, b: a == b != "N")):
        for i in range(n):
            for j in range(i + 1, min(n, i + 102)):
                if j - i > 2 and pair(s[i + 1], s[j - 1]):
                    continue
                r = 0
                while i - r >= 0 and j + r < n and pair(s[i - r], s[j + r]) and j - i + 2 * r <= 101 + 2 * most_arm:
                    r += 1
                if r >= least:
                    out.add((name, i - r + 1, j + r, r))
    return out


def walked_zdna(seq, minimum=50.0, penalty=3.0):
    """The caller's rule step by step."""
    out, i = [], 0
    while i < len(seq) - 1:
        total, best, end, bad, k = 0.0, 0.0, i, 0, i
        while k < len(seq) - 1:
            w = nonb.Z_WEIGHTS.get(seq[k : k + 2])
            bad = bad + 1 if w is None else 0
            total += -penalty * bad if w is None else w
            if total > best:
                best, end = total, k + 2
            if total <= 0 or best - total > minimum:
                break
            k += 1
        out += [(i, end, best)] if best >= minimum else []
        i = end - 1 if best >= minimum else k + 1
    return out


def test_repeats_by_seeds_are_complete():
    rng = random.Random(5)
    for n in (0, 5, 30, 120, 300, 300, 300):
        s = dna_of(rng, n)
        assert sorted(brute_repeats(s, 40)) == nonb.repeat_regions(s, 40)


def test_zdna_by_parts_is_the_walk():
    rng = random.Random(6)
    for _ in range(60):
        s = dna_of(rng, rng.choice([0, 1, 2, 50, 700]))
        assert nonb.zdna_regions(s) == walked_zdna(s)


def test_callers_over_tiles(spark):
    rng = random.Random(7)
    seqs = [(f"c{i}", dna_of(rng, n)) for i, n in enumerate((0, 1, 30, 700, 2500, 2500))] + [("cg", "CG" * 900), ("g", "G" * 700 + dna_of(rng, 300)), (None, dna_of(rng, 800)), ("none", None)]
    df = spark.createDataFrame(seqs, "id string, seq string")
    found = lambda df, *cols: sorted(tuple(r) for r in df.where("id IS NOT NULL").select(*cols).collect())
    for size in (7, 64, 311, 100_000):
        cut = tiles.tiled(df, "id", size=size)
        for caller, find in (("zdna", nonb.zdna_regions), ("g4hunter", nonb.g4hunter_regions)):
            want = sorted((i, a, b, pytest.approx(s)) for i, q in seqs if i for a, b, s in find(q or ""))
            assert want and found(tiled.call(cut, caller, "id"), "id", "start", "end", "score") == want, (size, caller)
        own = tiles.tiled(df, "id", size=size, left=200, right=200)
        want = sorted((i, c, a, b, float(arm)) for i, q in seqs if i for c, a, b, arm in nonb.repeat_regions(q or "", 25))
        assert found(tiled.call_repeats(own, "id", most_arm=25), "id", "class", "start", "end", "score") == want, size
    assert tiled.call(tiles.tiled(df.limit(0), "id"), "zdna", "id").count() == 0


def test_fasta_tiles(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(tiles, "LINE", 50)
    wrap = lambda s, w, end: end.join(s[i : i + w] for i in range(0, len(s), w))
    records = [("a long " + "x" * 120, dna_of(rng, 1500)), ("b", ""), ("c", dna_of(rng, 70)), ("d", "acgt" * 30), ("e", dna_of(rng, 333))]
    body = "ACGT before\n" + "".join(f">{h}\n" + wrap(s, 60, "\n") + "\n" for h, s in records)
    (tmp_path / "a.fa").write_text(body)
    (tmp_path / "b.fa").write_text("".join(f">{h}\r\n{s}\r\n" for h, s in records))  # each record one line
    with gzip.open(tmp_path / "c.fa.gz", "wt") as f:
        f.write(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    try:
        for size, left, right in ((100, 0, 0), (64, 10, 33), (5000, 20, 20)):
            got = tiles.fasta_tiles(spark, [str(tmp_path / n) for n in ("a.fa", "b.fa", "c.fa.gz")], size, left, right).collect()
            want = [(k, h.split()[0], h, t, t * size, min(len(s), (t + 1) * size), min(t * size, left), s.upper()[max(0, t * size - left) : (t + 1) * size + right]) for k, (h, s) in enumerate(records) for t in range(-(-len(s) // size))]
            for name in ("a.fa", "b.fa", "c.fa.gz"):
                assert sorted((r.record_ix, r.record_id, r.header, r.tile_ix, r.start, r.stop, r.lead, r.seq) for r in got if r.path.endswith(name)) == want, (name, size)
        kept = tiles.fasta_tiles(spark, str(tmp_path / "a.fa"), 100, headless=True).where("record_ix = -1").collect()
        assert [(r.record_id, r.seq) for r in kept] == [("NA", "ACGTBEFORE")]
        hits = tiled.call(tiles.fasta_tiles(spark, str(tmp_path / "b.fa"), 64), "zdna", "record_ix")
        assert sorted((r.record_ix, r.start, r.end) for r in hits.collect()) == sorted((k, a, b) for k, (_, s) in enumerate(records) for a, b, _ in nonb.zdna_regions(s.upper()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_hypergeometric_quantiles():
    from math import comb

    for total, marked, drawn in ((10, 4, 3), (7, 7, 2), (9, 0, 5), (30, 12, 20), (5, 5, 5)):
        share = [comb(marked, x) * comb(total - marked, drawn - x) / comb(total, drawn) for x in range(drawn + 1)]
        for u in (0.001, 0.2, 0.5, 0.77, 0.999):
            want = next(x for x in range(drawn + 1) if sum(share[: x + 1]) >= u - 1e-12)
            assert permutation.hypergeometric(u, total, marked, drawn) == want
    big = permutation.hypergeometric(0.5, 10**9, 4 * 10**8, 10**6)
    assert abs(big - 400_000) < 5


def test_label_shuffles(spark, monkeypatch):
    rng = random.Random(9)
    rows = [("same", rng.randrange(5), i % 2 == 0) for i in range(200)] + [("far", rng.randrange(5) + (0 if i % 2 else 4), i % 2 == 0) for i in range(200)] + [("one", 1, True), (None, 1, True), (None, 3, False)]
    df = spark.createDataFrame(rows, "g string, v int, f boolean")
    for block in (1 << 20, 30):  # one block, and several
        monkeypatch.setattr(permutation, "BLOCK_ROWS", block)
        got = {r.g: r for r in permutation.label_shuffles(df, "v", F.col("f"), 199, 3, "g").collect()}
        assert set(got) == {"same", "far", None} and got["far"].p == 1 / 200 and got["same"].p > 0.02 and got[None].p == 1.0
        a, b = ([v for g, v, f in rows if g == "far" and f is side] for side in (True, False))
        assert got["far"].delta == pytest.approx(sum(b) / len(b) - sum(a) / len(a)) and (got["far"].n1, got["far"].n2) == (100, 100)
    every = permutation.label_shuffles(df.where("g = 'same'"), "v", F.col("f"), 400, 4).first()
    x = [(v, f) for g, v, f in rows if g == "same"]
    obs = abs(sum(v for v, f in x if f) - sum(v for v, f in x if not f)) / 100
    hits = 0
    for _ in range(2000):  # by copying and shuffling
        labels = [f for _, f in x]
        rng.shuffle(labels)
        hits += abs(sum(v for (v, _), f in zip(x, labels) if f) - sum(v for (v, _), f in zip(x, labels) if not f)) / 100 >= obs - 1e-12
    assert abs(every.p - hits / 2000) < 0.1


def test_ranks_in_ranges(spark):
    rng = random.Random(10)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0, rng.random(), rng.random() * 9])) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, p double")
    ranks = {(r.g, r.p): (r._less, r._n, r._m) for r in stats.value_ranks(df, "p", "g").collect()}
    for g in ("a", "b", None):
        own = [p for h, p in rows if h == g and p is not None]
        for p in set(own):
            assert ranks[g, p] == (sum(x < p for x in own), own.count(p), len(own))
    for by in ((), ("g",)):
        got = stats.bh(df, "p", by).collect()
        assert len(got) == len(rows)
        for r in got:
            own = sorted(p for h, p in rows if p is not None and (not by or h == r.g))
            want = None if r.p is None else min(1.0, min(x * len(own) / (i + 1) for i, x in enumerate(own) if x >= r.p))
            assert r.q == (want if want is None else pytest.approx(want))
    placed = stats.hash_places(spark.createDataFrame([(i, i % 3) for i in range(300)], "k int, g int"), 4, "k", "g").collect()
    for g in range(3):
        own = sorted((hashlib.md5(f"4:{r.k}".encode()).hexdigest(), r._r, r._m) for r in placed if r.g == g)
        assert [(r, m) for _, r, m in own] == [(i + 1, 100) for i in range(100)]


def test_no_window_over_a_whole_group(spark):
    items = spark.createDataFrame([(i, i % 2, i / 7, "t") for i in range(50)], "item_id int, label int, score double, tag string")
    for df in (classifier.stratified_split(items, 0.3, 1), classifier.auroc(items, "tag"), stats.bh(items, "score", ("tag",))):
        for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines():
            if "Window [" in line:
                # by range as well, or over sums of ranges
                assert "_b#" in line.split("]")[1] + line.split("],")[-2] or "_t#" in line, line


def test_resumed_run_equals_a_full_one(spark, tmp_path):
    jobs = spark.createDataFrame([(f"k{i % 5}", i) for i in range(40)], "k string, v int")
    done = []

    def work(own):
        rows = own.groupBy("k").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
        done.extend(r.k for r in own.select("k").distinct().collect())
        return rows

    class Killed(Exception):
        pass

    def killed(own):
        if len(done) >= 2:
            raise Killed
        return work(own)

    path = f"file://{tmp_path}/run"
    with pytest.raises(Killed):
        resume.run(jobs, "k", killed, path, slices=10)
    first = set(done)
    assert 2 <= len(first) < 5
    broken = sorted(first)[0]
    for f in (tmp_path / "run" / "sentinels").glob("part-*"):
        f.write_text("".join('{"key": "' + broken + "\n" if f'"{broken}"' in line else line + "\n" for line in f.read_text().splitlines()))
    for f in (tmp_path / "run" / "sentinels").glob(".*.crc"):
        f.unlink()
    done.clear()
    full = resume.run(jobs, "k", work, path, slices=3)
    assert set(done) == {f"k{i}" for i in range(5)} - first | {broken}
    want = work(jobs).collect()
    assert sorted(map(tuple, full.select("k", "s", "n").collect())) == sorted(map(tuple, want))
    done.clear()
    assert resume.run(jobs, "k", work, path).count() == 5 and not done


def test_base_chunks(spark):
    rng = random.Random(11)
    texts = ["ACGTNNNNACGTACGTNA" * 3, "N" * 40, "", None, "ACG", "acgtACGTacgt" * 4, "ANCNGNTN" * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, seq string")
    got = classifier.base_chunks(df, 6, 40, 2, "i").collect()
    assert len(got) == 40 * len(texts)
    for r in got:
        text = (texts[r.i] or "N" * 6) if len(texts[r.i] or "") >= 6 or not texts[r.i] else (texts[r.i] * 3)[:6]
        cut = text[r.start : r.start + 6]
        assert set(r.chunk) <= set("ACGT") and all(a == b for a, b in zip(cut, r.chunk) if a in "ACGT") and (r.redrawn or cut == r.chunk)
    starts = {r.start for r in got if r.i == 0}
    assert starts == {s for s in range(len(texts[0]) - 5) if "N" not in texts[0][s : s + 6]}
    assert all(r.redrawn for r in got if r.i in (1, 2, 3, 6)) and rng


def test_own_backgrounds(spark):
    from itertools import product
    from math import log2, prod

    m = [[0.7, 0.1, 0.1, 0.1], [0.0, 0.5, 0.5, 0.0], [0.2, 0.2, 0.2, 0.4]]
    seqs = [("a", "ACGTACGATTACCAGT", [0.4, 0.1, 0.1, 0.4]), ("b", "ACGTACGATTACCAGT", [0.1, 0.4, 0.4, 0.1]), ("c", "ACGNACG", None), ("d", None, [0.25] * 4), ("e", "AAAA", [1.0, 0.0, 0.0, 0.0])]
    motifs = spark.createDataFrame([("M", "m", m)], "motif_id string, motif_alt_id string, matrix array<array<double>>")
    got = tfbs.scan_own(spark.createDataFrame(seqs, "i string, seq string, base array<double>"), motifs, "i", site_p=0.2).collect()
    want = []
    for i, s, base in seqs:
        k = [max(1, round(100 * b)) for b in base or [0.25] * 4]
        b = [x / sum(k) for x in k]
        grains = [[round(log2((p + 0.1 * q) / 1.1 / q) * 1000) for p, q in zip(row, b)] for row in m]
        words = [(sum(grains[j][c] for j, c in enumerate(w)), prod(b[c] for c in w)) for w in product(range(4), repeat=3)]
        for at in range(len(s or "") - 2):
            for strand, w in (("+", s[at : at + 3]), ("-", s[at : at + 3][::-1].translate(str.maketrans("ACGT", "TGCA")))):
                if "N" not in w:
                    score = sum(grains[j]["ACGT".index(c)] for j, c in enumerate(w))
                    p = sum(q for t, q in words if t >= score)
                    if p < 0.2 - 1e-12:
                        want.append((i, strand, at, score / 1000, round(p, 9)))
    assert sorted((r.i, r.strand, r.start, round(r.score, 3), round(r.p_value, 9)) for r in got) == sorted(want)


def test_readers_of_the_survey(spark, tmp_path):
    (tmp_path / "t.fa").write_text("ACG lost\n>r\nAC\n")
    assert [r.header for r in files.fasta(spark, str(tmp_path / "t.fa"), headless=False).collect()] == ["r"]
    d = spark.createDataFrame([(i, i % 2) for i in (5, 3, 9, 7)], "row_ix int, g int")
    assert {r.row_ix for r in files.first_of(d, 2).collect()} == {3, 5} and files.first_of(d, None).count() == 4 and {r.row_ix for r in files.first_of(d, 1, "row_ix", "g").collect()} == {3}
    head = "motif_id\tmotif_alt_id\tsequence_name\tstart\tstop\tstrand\tscore\tp-value\tq-value\tmatched_sequence\n"
    line = lambda p, q: f"M\tm\ts\t1\t2\t+\t3\t{p}\t{q}\tAC\n"
    for side, motif, rows in (("o", "A", line("1e-6", "0.01") * 2 + line("1e-3", "0.01") + line("x", "0.1")), ("o", "B", ""), ("s", "A", line("1e-6", "1")), ("s", "C", line("1e-6", "0.01"))):
        (tmp_path / side / motif).mkdir(parents=True)
        (tmp_path / side / motif / "fimo.tsv").write_text(head + rows)
    assert sorted(map(tuple, files.motif_folders(spark, str(tmp_path / "o"), str(tmp_path / "s")).collect())) == [("A", 2, 0), ("B", 0, 0)]
    shares = spark.createDataFrame([(0.3, 0.2, 0.1, 0.4)], "A double, C double, G double, T double")
    assert [r.value for r in files.background_lines(shares).collect()] == ["A 0.300000", "C 0.200000", "G 0.100000", "T 0.400000"]
    pool = spark.createDataFrame([("n", 1, 10), ("n", 1, 10), ("s", 1, 7)], "group string, genome_id int, length int")
    assert sorted(map(tuple, binning.pooled(pool).collect())) == [("n", 1, 10), ("s", 1, 7)]
    tags = classifier.tag_table(spark)
    assert {r.domain: r["count"] for r in tags.groupBy("domain").count().collect()} == {"eukaryotes": 20, "prokaryotes": 4, "viruses": 6}


def test_distance_curves(spark):
    rows = spark.createDataFrame([(0, 0.5, 0.1), (0, 0.7, 0.3), (100, None, 0.2), (100, 0.9, None)], "distance_bp int, auc double, f1 double")
    got = [tuple(r) for r in classifier.distance_curve(rows, "mean_auc").collect()]
    assert got == [(0.0, pytest.approx(0.6), pytest.approx(0.1414213562)), (100.0, 0.9, None)]
    summary = spark.createDataFrame([(100, 0.8, 0.1), (0, 0.9, 0.2)], "distance_bp int, mean_auc double, std_auc double")
    assert [tuple(r) for r in classifier.distance_curve(summary, "f1").collect()] == [(0.0, 0.9, 0.2), (100.0, 0.8, 0.1)]
    with pytest.raises(ValueError):
        classifier.distance_curve(rows, "acc")
