"""Evaluation of classifiers of natural and synthetic sequence, and the samples they are trained on."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from . import kmers


def auroc(scores: DataFrame, *by: str) -> DataFrame:
    """Rank-sum AUROC of (label, score); null with one class only."""
    r = stats.value_ranks(scores, "score", *by, sums={"_p": F.count_if(F.col("label") == 1), "_q": F.count_if(F.col("label") == 0)})
    g = r.groupBy(*by).agg(F.sum(F.col("_p") * (F.col("_less") + (F.col("_n") + 1) / 2)).alias("_s"), F.sum("_p").alias("n_pos"), F.sum("_q").alias("n_neg"))
    p, n = F.col("n_pos"), F.col("n_neg")
    return g.select(*by, "n_pos", "n_neg", F.when((p > 0) & (n > 0), (F.col("_s") - p * (p + 1) / 2) / (p * n)).alias("auc"))


def at_threshold(scores: DataFrame, threshold: float, *by: str) -> DataFrame:
    """Confusion counts, acc, precision, recall and f1 of score >= threshold; zero where undefined."""
    hit, pos = F.col("score") >= threshold, F.col("label") == 1
    g = scores.groupBy(*by).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return g.select("*", share(tp + tn, tp + fp + fn + tn).alias("acc"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def best_threshold(scores: DataFrame, *by: str) -> DataFrame:
    """The smallest of 0, the scores and 1 with the largest F1: threshold and best_f1."""
    part = [F.col(c) for c in by] or [F.lit(1)]
    ends = scores.select(*by).distinct().select(*by, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("score"), F.lit(0).alias("p"), F.lit(0).alias("n"))
    at = scores.select(*by, "score", (F.col("label") == 1).cast("int").alias("p"), (F.col("label") == 0).cast("int").alias("n")).unionByName(ends)
    g = at.groupBy(*by, "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    above = W.partitionBy(*part).orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    g = g.select(*by, "score", F.sum("p").over(above).alias("tp"), F.sum("n").over(above).alias("fp"), F.sum("p").over(W.partitionBy(*part)).alias("pos"))
    f1 = F.when(F.col("tp") + F.col("fp") + F.col("pos") > 0, 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("pos"))).otherwise(F.lit(0.0))
    return g.withColumn("f1", f1).groupBy(*by).agg(F.max_by("score", F.struct(F.col("f1"), -F.col("score"))).alias("threshold"), F.max("f1").alias("best_f1"))


def stratified_split(items: DataFrame, fraction: float, seed: int, key: str = "item_id", label: str = "label") -> DataFrame:
    """Marks round(n * fraction) items of each label as calibration rows."""
    r = stats.hash_places(items, seed, key, label)
    return r.withColumn("calibration", F.col("_r") <= F.bround(F.col("_m") * fraction, 0)).drop("_r", "_m")


def leave_one_out(items: DataFrame, tag: str = "tag") -> DataFrame:
    """Train and test rows of each fold: a tag is held out, all others train."""
    tags = items.select(F.col(tag).alias("holdout_tag")).distinct()
    return items.crossJoin(F.broadcast(tags)).withColumn("role", F.when(F.col(tag) == F.col("holdout_tag"), "test").otherwise("train"))


def fold_summary(folds: DataFrame, *by: str) -> DataFrame:
    """Means over tags, the smallest AUC and its tag."""
    return folds.groupBy(*by).agg(
        F.avg("auc").alias("mean_auc"), F.avg("f1").alias("mean_f1"), F.avg("acc").alias("mean_acc"), F.min("auc").alias("min_auc"),
        F.min_by("holdout_tag", F.when(F.col("auc").isNotNull(), F.struct("auc", "holdout_tag"))).alias("worst_tag"), F.count_distinct("holdout_tag").alias("n_tags"),
    )


def distance_summary(rows: DataFrame) -> DataFrame:
    """Per distance: mean and sample deviation of auc and acc, and the number of tags; rows without auc are left out."""
    return rows.where(F.col("auc").isNotNull()).groupBy("distance_bp").agg(
        F.avg("auc").alias("mean_auc"), F.stddev_samp("auc").alias("std_auc"), F.avg("acc").alias("mean_acc"), F.stddev_samp("acc").alias("std_acc"), F.count_distinct("holdout_tag").alias("n_tags")
    )


def fixed_chunks(seqs: DataFrame, length: int, distances: list[int], *keep: str, seq: str = "seq") -> DataFrame:
    """The piece of ``length`` letters at each distance, where it fits."""
    d = F.explode(F.array(*map(F.lit, distances))).alias("distance_bp")
    return seqs.select(*keep, seq, d).where(F.col("distance_bp") + length <= F.length(seq)).select(*keep, "distance_bp", F.substr(seq, F.col("distance_bp") + 1, F.lit(length)).alias("chunk"))


def sampled_chunks(seqs: DataFrame, length: int, n: int, seed: int, key: str, *keep: str, seq: str = "seq") -> DataFrame:
    """``n`` pieces of each sequence at places fixed by the seed; short sequences are repeated first."""
    padded = F.when(F.length(seq) < length, F.substring(F.repeat(F.col(seq), F.ceil(F.lit(float(length)) / F.greatest(F.lit(1), F.length(seq))).cast("int")), 1, length)).otherwise(F.col(seq))
    s = seqs.where(F.length(seq) > 0).select(*keep, key, padded.alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("chunk_ix"))
    at = (stats.draw(seed, F.col(key), F.col("chunk_ix")) % (F.length("_s") - length + 1)).cast("int")
    return s.select(*keep, key, "chunk_ix", at.alias("start"), F.substr("_s", at + 1, F.lit(length)).alias("chunk"))


def base_chunks(seqs: DataFrame, length: int, n: int, seed: int, key: str, *keep: str, seq: str = "seq") -> DataFrame:
    """``n`` pieces of A, C, G and T only of each sequence: (keep, key, chunk_ix, start, redrawn, chunk).

    A running count of other letters gives the starts of pieces without any, of
    which the draw picks one; that is what drawing places until one fits comes
    to, without a limit of tries.  A sequence without such a place gives a piece
    from any, its other letters redrawn.  Short sequences are repeated first,
    and an empty or null one is all drawn.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keep, key]
        for batch in batches:
            rows = []
            for i, (own, text) in enumerate(zip(batch.column(key).to_pylist(), batch.column("_s").to_pylist(), strict=True)):
                text = text or "N" * length
                if len(text) < length:
                    text = (text * (length // len(text) + 1))[:length]
                other = np.r_[0, np.cumsum(kmers.LETTERS[np.frombuffer(text.encode("ascii", "replace"), np.uint8)] == 4)]
                fit = np.flatnonzero(other[length:] == other[:-length])
                for c in range(n):
                    at = counter(seed, own, c)
                    start = int(fit[at % len(fit)]) if len(fit) else at % (len(text) - length + 1)
                    chunk = text[start : start + length]
                    if not len(fit):
                        chunk = "".join(x if x in BASES else BASES[counter(seed, own, c, j) % 4] for j, x in enumerate(chunk))
                    rows.append((i, c, start, not len(fit), chunk))
            if rows:
                at, ix, start, redrawn, chunk = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in names), pa.array(ix, pa.int32()), pa.array(start, pa.int64()), pa.array(redrawn), pa.array(chunk)], names=[*names, "chunk_ix", "start", "redrawn", "chunk"])

    rows = seqs.select(*keep, key, F.col(seq).alias("_s"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(cut, ", ".join([*kinds, "chunk_ix int, start long, redrawn boolean, chunk string"]))


def counter(*key: object) -> int:
    """As ``stats.draw``, for one key."""
    return int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:8], 16)


def item_probabilities(chunk_logits: DataFrame, *item: str) -> DataFrame:
    """Mean logit of an item's pieces and its sigmoid."""
    m = chunk_logits.groupBy(*item).agg(F.avg("logit").alias("logit"))
    return m.withColumn("prob", 1 / (1 + F.exp(-F.col("logit"))))


def shuffled_labels(items: DataFrame, seed: int, tag: str = "tag", key: str = "item_id") -> DataFrame:
    """Labels permuted within each tag by the order of a hash."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    a = items.withColumn("_r", F.row_number().over(W.partitionBy(tag).orderBy(key)))
    b = items.select(F.col(tag).alias("_t"), F.col("label").alias("_l"), F.row_number().over(W.partitionBy(tag).orderBy(order, key)).alias("_q"))
    return a.join(b, (F.col(tag) == F.col("_t")) & (F.col("_r") == F.col("_q"))).drop("label", "_r", "_t", "_q").withColumnRenamed("_l", "label")


#: The bases in the order of a one-hot matrix's rows.
BASES = "ACGT"


def one_hot(chunk: str = "chunk"):
    """Four arrays of 0 and 1, for A, C, G and T; other letters are zero in all of them, lower case counts."""
    letters = F.split(F.upper(F.col(chunk)), "")
    row = lambda b: F.transform(letters, lambda x: (x == b).cast("tinyint"))
    return F.when(F.length(chunk) == 0, F.transform(F.array(*map(F.lit, BASES)), lambda _: F.array().cast("array<tinyint>"))).otherwise(F.array(*map(row, BASES)))


def labelled(pairs: DataFrame, *keep: str) -> DataFrame:
    """Pairs (orig, syn) as one row a file: keep, which, label (orig 0, syn 1) and file."""
    side = lambda name, label: F.struct(F.lit(name).alias("which"), F.lit(label).alias("label"), F.col(name).alias("file"))
    return pairs.select(*keep, F.explode(F.array(side("orig", 0), side("syn", 1))).alias("_x")).select(*keep, "_x.*")


def distance_rows(scores: DataFrame, distances: list[int], threshold: float, tag: str = "tag") -> DataFrame:
    """AUROC and the metrics at a threshold for every tag and distance; null where a class is missing, with n_used.

    ``scores`` is (tag, distance_bp, label, score).  The grid is as large as the result.
    """
    grid = scores.select(tag).distinct().select(tag, F.explode(F.array(*map(F.lit, distances))).alias("distance_bp"))
    s = scores.withColumn("distance_bp", F.col("distance_bp").cast("int"))
    m = at_threshold(s, threshold, tag, "distance_bp").join(auroc(s, tag, "distance_bp"), [tag, "distance_bp"])
    g = grid.join(m, [tag, "distance_bp"], "left")
    known = F.col("auc").isNotNull()
    return g.select(
        F.col(tag).alias("holdout_tag"), "distance_bp", "auc", *(F.when(known, F.col(c)).alias(c) for c in ("acc", "f1", "precision", "recall")),
        F.lit(float(threshold)).alias("thr"), F.coalesce(F.col("n_pos") + F.col("n_neg"), F.lit(0)).alias("n_used"),
    )


def allowed(rows: DataFrame, allow: DataFrame, domain: str = "domain", tag: str = "tag") -> DataFrame:
    """Rows whose tag is listed for their domain; a domain that is not listed keeps all of its rows."""
    names = allow.select(F.col("domain").alias("_d"), F.col("tag").alias("_t")).distinct()
    listed = rows.join(names, (F.col(domain) == F.col("_d")) & (F.col(tag) == F.col("_t")), "left_semi")
    free = rows.join(names.select("_d").distinct(), F.col(domain) == F.col("_d"), "left_anti")
    return listed.unionByName(free)


def by_chunk_count(rows: DataFrame, metric: str) -> DataFrame:
    """Mean and sample deviation of a metric and the number of tags for each domain and n_eval_chunks; rows without a count are left out."""
    return rows.where(F.col("n_eval_chunks").isNotNull()).groupBy("domain", "n_eval_chunks").agg(
        F.avg(metric).alias("mean_metric"), F.stddev_samp(metric).alias("std_metric"), F.count_distinct("holdout_tag").alias("n_tags")
    )


def merged(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables of several domains one under another, with their domain; a column that one lacks is null there."""
    out = None
    for name, t in tables.items():
        t = t.withColumn("domain", F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables to merge")
    return out


#: Tags of each domain (fixed values).
TAGS = {
    "eukaryotes": (
        "Aedes_aegypti", "Apis_mellifera", "Arabidopsis_thaliana", "Bos_taurus", "Branchiostoma_floridae", "Caenorhabditis_elegans", "Canis_familiaris_lupus", "Danio_rerio",
        "Drosophila_melanogaster", "Gallus_gallus", "Gossypium_barbadense", "Homo_sapiens", "Mus_musculus", "Nematostella_vectensis", "Oryza_sativa", "Saccharina_japonica",
        "Takifugu_rubripes", "Triticum_aestivum", "Xenopus_tropicalis", "Zea_mays",
    ),
    "prokaryotes": ("Archaea", "Chlamydiota", "Mycoplasmatota", "Pseudomonadota"),
    "viruses": ("Kitrinoviricota", "Nucleocytoviricota", "Peploviricota", "Preplasmiviricota", "Uroviricota", "megaDNA_bacteriophages"),
}


def tag_table(spark: SparkSession) -> DataFrame:
    """(domain, tag) of all tags."""
    return spark.createDataFrame([(d, t) for d, tags in TAGS.items() for t in tags], "domain string, tag string")


def distance_curve(table: DataFrame, metric: str) -> DataFrame:
    """(distance_bp, y, y_std) of a summary (columns mean_*) or of rows of tags, told apart by their columns.

    A summary that lacks the metric's mean gives that of auc; y_std is null where the summary has none.
    """
    if "distance_bp" not in table.columns:
        raise ValueError("the table lacks distance_bp")
    if any(c.startswith("mean_") for c in table.columns):
        mean = f"mean_{metric}" if f"mean_{metric}" in table.columns else "mean_auc"
        if mean not in table.columns:
            raise ValueError(f"the summary lacks {mean}")
        std = next((c for c in (f"std_{metric}", "std_auc") if c in table.columns), None)
        return table.select(F.col("distance_bp").cast("double"), F.col(mean).cast("double").alias("y"), (F.col(std) if std else F.lit(None)).cast("double").alias("y_std")).orderBy("distance_bp")
    metric = "auc" if metric == "mean_auc" else metric
    if metric not in table.columns:
        raise ValueError(f"the table lacks {metric}")
    known = table.where(F.col(metric).isNotNull() & ~F.isnan(F.col(metric).cast("double")))
    return known.groupBy(F.col("distance_bp").cast("double").alias("distance_bp")).agg(F.avg(metric).alias("y"), F.stddev_samp(metric).alias("y_std")).orderBy("distance_bp")
