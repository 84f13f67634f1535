"""Long sequences as tiles, so that a chromosome is never one row.

A tile has the letters ``[start, stop)`` of its sequence, ``lead`` letters
before them and some behind them (halos, cut at the sequence's ends):
``seq[lead : lead + stop - start]`` are the tile's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna

TILE = 1 << 20
#: A line of more letters is cut before Python sees it.
LINE = 1 << 16
#: Blocks of files whose places every task is told; more files have to be read in several calls.
MOST_BLOCKS = 200_000


def tiled(seqs: DataFrame, *keep: str, size: int = TILE, left: int = 0, right: int = 0, seq: str = "seq") -> DataFrame:
    """(keep, tile_ix, start, stop, lead, seq) of sequences that are rows already; nothing is shuffled."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("_s")[i].as_py() or ""
                begin = range(0, len(text), size)
                lead = [min(b, left) for b in begin]
                pieces = [text[b - le : b + size + right] for b, le in zip(begin, lead, strict=True)]
                n = len(pieces)
                own = [batch.column(c).take(pa.array([i] * n, pa.int64())) for c in keep]
                yield pa.RecordBatch.from_arrays([*own, pa.array(range(n), pa.int64()), pa.array(begin, pa.int64()), pa.array([min(len(text), b + size) for b in begin], pa.int64()), pa.array(lead, pa.int64()), pa.array(pieces, pa.string())], names=[*keep, *COLUMNS])

    types = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in seqs.select(*keep).schema), SCHEMA])
    return seqs.select(*keep, F.col(seq).alias("_s")).mapInArrow(cut, types)


COLUMNS = ("tile_ix", "start", "stop", "lead", "seq")
SCHEMA = "tile_ix long, start long, stop long, lead long, seq string"


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, block and text of each line in file order; very long lines in several pieces."""
    t = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    pieces = F.when(F.length("value") <= LINE, F.array("value")).otherwise(F.regexp_extract_all("value", F.lit(f"(.{{1,{LINE}}})"), 1))
    # a piece of a long sequence line may begin with >, a header may be long: only a line's first piece is a header
    return t.select("path", "block", F.posexplode(pieces).alias("piece", "value"), F.startswith("value", F.lit(">")).alias("header"))


def _blocks(lines: DataFrame) -> DataFrame:
    """For each block of a file: headers and letters before it, letters since the last header before it, and that header."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_block, state = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(("path", "block", "headers", "letters", "tail", "last"), (*open_block, *state), strict=True))], schema=kind)

        kind = pa.schema([("path", pa.string()), ("block", pa.int64()), ("headers", pa.int64()), ("letters", pa.int64()), ("tail", pa.int64()), ("last", pa.string())])
        for batch in batches:
            for path, block, piece, value, header in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "piece", "value", "header")), strict=True):
                if (path, block) != open_block:
                    if open_block:
                        yield row()
                    open_block, state = (path, block), [0, 0, 0, None]
                if header:
                    if piece == 0:
                        state[0], state[2], state[3] = state[0] + 1, 0, value
                    else:
                        state[3] += value
                else:
                    n = len("".join(value.split()))
                    state[1], state[2] = state[1] + n, state[2] + n
        if open_block:
            yield row()

    b = lines.mapInArrow(summary, "path string, block long, headers long, letters long, tail long, last string")
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    b = b.select("*", F.coalesce(F.sum("letters").over(before), F.lit(0)).alias("_all"))
    b = b.select("*", F.when(F.col("headers") > 0, F.col("_all") + F.col("letters") - F.col("tail")).alias("_at"))
    return b.select(
        "path", "block", F.coalesce(F.sum("headers").over(before), F.lit(0)).alias("headers"), (F.col("_all") - F.coalesce(F.last("_at", ignorenulls=True).over(before), F.lit(0))).alias("offset"),
        F.last("last", ignorenulls=True).over(before).alias("header"),
    )


def fasta_tiles(spark: SparkSession, paths: str | list[str], size: int = TILE, left: int = 0, right: int = 0, softmask_to_n: bool = False, headless: bool = False) -> DataFrame:
    """Tiles of the records of FASTA files: path, record_ix, record_id, header and the columns of a tile.

    Files are read in splits, as text, wherever they are; a task holds one tile
    and one line.  A first pass counts headers and letters of each split, a
    running sum over the splits of a file tells where each one begins, and a
    second pass sends letters to their tiles.  Text before the first header is
    left out, or with ``headless`` is record -1.  Empty records have no tiles.
    """
    if max(left, right) > size:
        raise ValueError("a halo can't be longer than a tile")
    lines = _lines(spark, paths)
    table = _blocks(lines).limit(MOST_BLOCKS + 1).collect()
    if len(table) > MOST_BLOCKS:
        raise ValueError("too many blocks for one call")
    begins = {(b.path, b.block): (b.headers - 1, b.offset, b.header) for b in table}

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[str] = []
        place = path = None
        record = offset = held_size = 0
        name: str | None = None

        def flush() -> None:
            nonlocal offset, held_size
            text, at = "".join(held), offset
            held.clear()
            offset, held_size = offset + len(text), 0
            while text:
                tile = at // size
                own, text = text[: (tile + 1) * size - at], text[(tile + 1) * size - at :]
                out.append((path, record, name, tile, at, own))
                if tile and at < tile * size + right:
                    out.append((path, record, name, tile - 1, at, own[: tile * size + right - at]))
                edge = (tile + 1) * size - left
                if at + len(own) > edge and left:
                    out.append((path, record, name, tile + 1, max(at, edge), own[max(0, edge - at) :]))
                at += len(own)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "record_ix", "header", "tile_ix", "at", "part"])

        for batch in batches:
            for own_path, block, piece, value, header in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "piece", "value", "header")), strict=True):
                if (own_path, block) != place:
                    flush()
                    place, path = (own_path, block), own_path
                    record, offset, name = begins[place]
                if header:
                    flush()
                    if piece == 0:
                        record, offset, name = record + 1, 0, value
                    else:
                        name += value
                elif record >= 0 or headless:
                    letters = "".join(value.split())
                    held.append(letters)
                    held_size += len(letters)
                    if held_size >= size:
                        flush()
                if sum(len(r[5]) for r in out[-4:]) and len(out) >= 16:
                    yield batch_of(out)
                    out = []
        flush()
        if out:
            yield batch_of(out)

    parts = lines.mapInArrow(fragments, "path string, record_ix long, header string, tile_ix long, at long, part string")
    # a part's end tells tiles apart from mere halos of a tile that does not exist
    g = parts.groupBy("path", "record_ix", "tile_ix").agg(
        F.max("header").alias("header"), F.min("at").alias("_from"), F.max(F.col("at") + F.length("part")).alias("_to"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "").alias("_s"),
    )
    start = F.col("tile_ix") * size
    head = F.regexp_extract("header", r"^>([^\r\n]*)", 1)
    g = g.where(F.col("_to") > start)
    return g.select(
        "path", "record_ix", dna.record_id(head).alias("record_id"), head.alias("header"), "tile_ix", start.alias("start"), F.least(F.col("_to"), start + size).alias("stop"),
        (start - F.col("_from")).alias("lead"), dna.clean("_s", softmask_to_n).alias("seq"),
    )
