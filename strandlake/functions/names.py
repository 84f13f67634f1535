"""What the names of files and runs tell, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dna import col


def base_name(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def motif_in(path: Column | str) -> Column:
    """DR, IR, MR, STR or GQ between underscores or dots of the file's name; UNK without one."""
    found = F.upper(F.regexp_extract(base_name(path), r"(?i)(?:^|[_.])(DR|IR|MR|STR|GQ)(?:[_.]|$)", 1))
    return F.when(found == "", "UNK").otherwise(found)


def side_in(path: Column | str) -> Column:
    """orig or syn; a name with both is told by the whole part, orig first; unk without either."""
    b = F.lower(base_name(path))
    whole = lambda s: b.rlike(rf"_{s}_|_{s}\.(?:tsv|gff)$")
    return F.when(whole("orig"), "orig").when(whole("syn"), "syn").when(b.contains("_orig"), "orig").when(b.contains("_syn"), "syn").otherwise("unk")


def genome_id(path: Column | str) -> Column:
    """The file's name without .gz and one FASTA ending."""
    return F.regexp_replace(F.regexp_replace(base_name(path), r"\.gz$", ""), r"\.(?:fna|fa|fasta)$", "")


def dataset_label(path: Column | str, otherwise: str = "dataset") -> Column:
    """What follows ``pairs`` in a manifest's name, else the name, else a default."""
    b = F.regexp_replace(base_name(path), r"(?i)\.csv$", "")
    return F.coalesce(F.nullif(F.regexp_extract(b, r"(?i)pairs[._-](.+)$", 1), F.lit("")), F.nullif(b, F.lit("")), F.lit(otherwise))


def eval_chunks(run_id: Column | str) -> Column:
    """The number after ``nev``; null without one."""
    return F.nullif(F.regexp_extract(col(run_id), r"nev(\d+)", 1), F.lit("")).cast("int")


def run_domain(run_id: Column | str, renamed: dict[str, str] | None = None) -> Column:
    """The part of a run's name before its first underscore, renamed if listed."""
    first = F.substring_index(col(run_id), "_", 1)
    pairs = [F.lit(x) for kv in (renamed or {}).items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), first), first) if pairs else first


def support_parts(path: Column | str) -> Column:
    """tag, k, bin, lo and hi of a ``TAG.kK.binN_Llo_to_hi.support_stats.csv`` name; what a shorter name lacks is null.

    The name is split at its last ``.kK``, then its bin, then the bin's range.
    """
    b = base_name(path)
    whole = rf"^(.+)\.k(\d+)(?:\.bin(\d+)(?:_L(\d+)_to_(\d+)|.+)|.+){SUPPORT}$"
    parts = [F.nullif(F.regexp_extract(b, whole, i), F.lit("")) for i in range(1, 6)]
    tag = F.coalesce(parts[0], F.regexp_replace(b, r"(?<=.)\.[^.]*$", ""))
    return F.struct(tag.alias("tag"), *(p.cast(t).alias(n) for p, n, t in zip(parts[1:], ("k", "bin", "lo", "hi"), ("int", "int", "long", "long"), strict=True)))


#: How names of support tables end (fixed value).
SUPPORT = r"\.support_stats\.csv"


def has_prefix(path: Column | str, tag: str | None = None, k: int | None = None) -> Column:
    """Whether a file belongs to a tag (its name begins with it) and to a k (``.kK.`` in its name)."""
    b = base_name(path)
    return (b.startswith(tag) if tag else F.lit(True)) & (b.contains(f".k{k}.") if k is not None else F.lit(True))
