"""Removal of repeated line runs by a suffix array over line ids.

A document is a sequence of line ids (hashes of the lines without outer white space; lines without words take no part). Ids that
occur once can't be in a repeated run and part the sequences. On what remains, distributed prefix doubling names the runs of
1, 2, 4, ... lines: the pairs of names at a position and half a run later are sorted by range over the cluster, and a pair's place
in that order, among pairs that occur twice or more, is its rank, so ranks of equal name are the intervals of a suffix array
whose common prefix has so many lines.

A line goes if a run of lines with MIN_WORDS words or more that covers it also starts earlier. It is enough to look at runs that
just reach MIN_WORDS forwards from a line, or backwards: a longer repeated run is the union of such. A run of n lines is named by
the ranks of its first and its last 2^k lines, 2^k <= n; of the places of one name the earliest stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.storage import bounded_batches, collect_garbage, discard, small_steps, table, written
from stratalens.llm.textbytes import Spans, slices, text_bytes, word_spans

MIN_WORDS = 50
_NULL_ID = (1 << 63) - 1
_AT = ["__doc", "__tie"]


def line_table(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every line with words: row, number of the line in its text, id, words."""
    raw, at = text_bytes(column)
    start, end, _ = word_spans(raw, at)
    breaks = np.flatnonzero(raw == 10)
    # A word's line: breaks before it; rows' first lines are counted from their own.
    line = np.searchsorted(breaks, start)
    row = np.searchsorted(at, start, "right") - 1
    first = np.ones(start.size, bool)
    first[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(first)
    tail = np.append(head[1:], start.size) - 1 if head.size else head
    ids = Spans(raw).hash(start[head], end[tail]).view(np.int64)
    return row[head], line[head] - np.searchsorted(breaks, at[row[head]]), ids, tail - head + 1


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            row, number, ids, words = line_table(part.column("text"))
            seq = np.arange(row.size) - np.searchsorted(row, row)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([part.column("__doc").take(at), part.column("__tie").take(at), pa.array(seq.astype(np.int32)), pa.array(ids), pa.array(words.astype(np.int32))], ["__doc", "__tie", "seq", "id", "words"])


def _runs(min_words: int):
    """The shortest runs of `min_words` words from each line on, and up to each line, within stretches of repeated lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, ties, starts, sizes = [], [], [], []
            for doc, tie, each in zip(batch.column("__doc").to_pylist(), batch.column("__tie").to_pylist(), batch.column("each"), strict=True):
                seq, words = (each.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                order = np.argsort(seq)
                seq, words = seq[order], words[order]
                cuts = np.flatnonzero(np.diff(seq) != 1) + 1
                total = np.concatenate([[0], np.cumsum(words)])
                limit = np.searchsorted(cuts, np.arange(seq.size), "right")
                low, high = np.concatenate([[0], cuts])[limit], np.concatenate([cuts, [seq.size]])[limit]
                here = np.arange(seq.size)
                to = np.searchsorted(total, total[:-1] + min_words)  # first end with enough words
                back = np.searchsorted(total, total[1:] - min_words, "right") - 1
                forward, backward = to <= high, (total[1:] - min_words >= 0) & (back >= low)
                pairs = np.unique(np.concatenate([np.stack([here[forward], to[forward]]), np.stack([back[backward], here[backward] + 1])], axis=1), axis=1)
                docs += [doc] * pairs.shape[1]
                ties += [tie] * pairs.shape[1]
                starts.append(seq[pairs[0]])
                sizes.append(pairs[1] - pairs[0])
            flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ties, pa.int32()), pa.array(flat(starts).astype(np.int32)), pa.array(flat(sizes).astype(np.int32))], ["__doc", "__tie", "seq", "size"])

    return run


def _cut(text: pd.Series, ranges: pd.Series) -> pd.DataFrame:
    out = []
    for t, spans in zip(text, ranges, strict=True):
        if spans is None or t is None:
            lines = 0 if t is None else t.count("\n") + 1
            out.append((t, lines, 0, 0))
            continue
        lines = t.split("\n")
        row, number, _, _ = line_table(pa.array([t], pa.large_string()))
        gone = np.zeros(number.size + 1, np.int64)
        for s in spans:
            gone[s["seq"]] += 1
            gone[s["seq"] + s["size"]] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        dead = set(number[mask].tolist())
        runs = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out.append(("\n".join(x for i, x in enumerate(lines) if i not in dead), len(lines), len(dead), runs))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_removed", "n_runs"])


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, into: str = "line_dedup") -> DataFrame:
    """`docs` (doc_id, text, any others) with the later copies of repeated line runs taken out of `text`, and a struct column
    `into` of n_lines, n_removed (lines with words) and n_runs.

    Order is that of doc_id (null last), then a hash of the text, then lines; rows equal in id and text count as one document.
    Null and empty texts, and lines without words, stay as they are.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID))).withColumn("__tie", F.hash("text"))
    lines = written(base.select(*_AT, "text").mapInArrow(_lines, "__doc long, __tie int, seq int, id long, words int"), "lines")
    shared = lines.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    repeated = written(lines.join(shared.hint("merge"), "id").select(*_AT, "seq", "id", "words").distinct(), "repeated")
    discard(lines)
    collect_garbage(spark)
    runs = repeated.groupBy(*_AT).agg(F.collect_list(F.struct("seq", "words")).alias("each")).mapInArrow(_runs(min_words), "__doc long, __tie int, seq int, size int")
    runs = written(runs.withColumn("level", F.floor(F.log2(F.col("size").cast("double")) + 1e-9).cast("int")), "runs")
    levels = runs.agg(F.max("level")).first()[0]
    names = repeated.select(*_AT, "seq", F.col("id").alias("name"))
    removed, used = [], [repeated, runs]
    with small_steps(spark):
        for level in range((-1 if levels is None else levels) + 1):
            half = 1 << level
            last = names.select(*_AT, F.col("seq").alias("end"), F.col("name").alias("name_end"))
            named = runs.filter(F.col("level") == level).join(names, [*_AT, "seq"]).withColumn("end", F.col("seq") + F.col("size") - half).join(last, [*_AT, "end"])
            named = written(named.select(*_AT, "seq", "size", "name", "name_end"), "named")
            used.append(named)
            first = named.groupBy("size", "name", "name_end").agg(F.min(F.struct(*_AT, "seq")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
            removed.append(named.join(first, ["size", "name", "name_end"]).filter(F.struct(*_AT, "seq") > F.col("first")).select(*_AT, "seq", "size"))
            if level < levels:
                after = names.select(*_AT, (F.col("seq") - half).alias("seq"), F.col("name").alias("next"))
                pairs = written(names.join(after, [*_AT, "seq"]), "pairs")
                twice = pairs.groupBy("name", "next").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name", "next")
                ranked = written(twice.repartitionByRange("name", "next").sortWithinPartitions("name", "next").withColumn("rank", F.monotonically_increasing_id()), "ranks")
                names = written(pairs.join(ranked, ["name", "next"]).select(*_AT, "seq", F.col("rank").alias("name")), "names")
                discard(pairs, ranked)
                used.append(names)
            collect_garbage(spark)
    if not removed:
        return base.withColumn(into, F.struct(F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_runs"))).drop(*_AT)
    every = removed[0]
    for more in removed[1:]:
        every = every.union(more)
    with small_steps(spark):
        ranges = written(every.groupBy(*_AT).agg(F.collect_list(F.struct("seq", "size")).alias("__ranges")), "line-ranges")
    discard(*used)
    collect_garbage(spark)
    cut = F.pandas_udf(_cut, "text string, n_lines long, n_removed long, n_runs long")
    # By merging at every size: ranges are small next to texts only on small tables.
    found = base.join(ranges.hint("merge"), _AT, "left").withColumn("__cut", cut(F.col("text"), F.col("__ranges")))
    return found.withColumn("text", F.col("__cut.text")).withColumn(into, F.struct("__cut.n_lines", "__cut.n_removed", "__cut.n_runs")).select(*docs.columns, into)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", "line_dedup.n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
