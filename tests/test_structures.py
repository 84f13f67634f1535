"""Callers over many sequences at once against those of one sequence."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from strandlake.operators import nonb, structures, tiled
from strandlake.plans import scale
from strandlake.sources import tiles


def expected(text):
    rows = [("GQ", *x) for x in nonb.g4hunter_regions(text)] + [("Z_DNA", *x) for x in nonb.zdna_regions(text)]
    return sorted(rows + [tuple(x) for x in nonb.repeat_regions(text)])


def sequences(rng, n):
    draw = lambda letters, size: "".join(rng.choices(letters, k=size))
    for _ in range(n):
        text = draw(rng.choice(["ACGT", "AC", "GC", "ACGTN", "GGGGCN", "A", "acgtACGT", "\u00e9ACG"]), rng.choice([0, 1, 5, 10, 25, 60, 200, 700]))
        if rng.random() < 0.5:  # a long repeat of each kind
            arm = draw("ACGT", rng.randint(10, 330))
            turned = rng.choice([arm, arm[::-1], arm[::-1].translate(str.maketrans("ACGT", "TGCA"))])
            text = text + arm + draw("ACGTN", rng.choice([0, 3, 10, 11, 100, 101])) + turned + text[:30]
        yield rng.choice([text] * 9 + [None])


def test_many_sequences_at_once():
    rng = random.Random(4)
    for most in (10, 300, 5000, structures.CHUNK):
        rows = list(sequences(rng, 60))
        got = {i: [] for i in range(len(rows))}
        for row, c, begin, end in structures.chunks(pa.array(rows, pa.string()), most):
            for name in tiled.CLASSES:
                for a, b, s in zip(*(x.tolist() for x in structures.hits(c, begin, end, name)), strict=True):
                    i = int(np.searchsorted(begin, a, "right")) - 1
                    got[row + i].append((name, a - int(begin[i]), b - int(begin[i]), s))
        assert {i: sorted(v) for i, v in got.items()} == {i: expected(t or "") for i, t in enumerate(rows)}


def test_tallies_over_tiles(spark):
    rng = random.Random(5)
    rows = [(f"p{i}", t) for i, t in enumerate(sequences(rng, 20))]
    rows += [("long", "".join(rng.choices("ACGTGGGN", k=6000)) + "CG" * 1500 + "A" * 2000 + "".join(rng.choices("ACGT", k=3000))), ("same", "ACG" * 2500)]
    want = Counter()
    for p, t in rows:
        for name, a, b, _ in expected(t or ""):
            want[p, name, "n"] += 1
            want[p, name, "bp"] += b - a
    df = spark.createDataFrame(rows, "p string, seq string")
    for size in (1500, 1 << 20):
        got = tiled.tallied(tiles.tiled(df, "p", size=size, left=tiled.HALO, right=tiled.HALO), "p").collect()
        assert {(r.p, r["class"], c): v for r in got for c, v in (("n", r.n_hits), ("bp", r.bp_covered))} == want
    some = tiled.tallied(tiles.tiled(df, "p", size=1500, left=tiled.HALO, right=tiled.HALO), "p", classes=("STR", "GQ")).collect()
    assert {(r.p, r["class"]): r.n_hits for r in some} == {k[:2]: v for k, v in want.items() if k[1] in ("STR", "GQ") and k[2] == "n"}


def test_sequences_are_made_and_searched_once(spark):
    plan = scale.nonb_tidy(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
