"""Spelling variants of the corpus's words by anagram hashing.

A word's key is the sum of the fifth powers of its letters: words with the same letters share it, one more or one fewer letter changes
it by that letter's power, an exchanged letter by a difference of two. Classes of words with one key are linked by joins on integers:
a key less one of its letters is the key of another class (a letter more or less), or it is what another class has less one of its own
(an exchange). Only words of linked classes have their letter order checked, by joins again: what is left of a word without the letter
at a place must be the whole of the other word, or be left of the other without its letter at that place. Such a group holds one
word for each letter of the alphabet at most, so a class of any number of anagrams never meets another word by word. Words that
agree are compared letter by letter.

Forms are followed by pointer doubling: counts rise tenfold at every step, which bounds the number of rounds.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.storage import bounded_batches, discard, table, written
from stratalens.llm.textbytes import Spans, slices

#: Power of the letters' code points in a key; shortest word; fewest occurrences; times that a form is more frequent.
POWER, LEAST, TWICE, TIMES = 5, 7, 2, 10
#: One of so many runs of a document, by its checksum, loses a letter.
DAMAGED = 31
#: Distinct words that a task counts before it passes them on. Results don't depend on it.
KEPT = 200_000
#: Letters are U+0041-005A, U+0061-007A and U+00C0-00FF, one byte each in Latin-1; in it lower() changes A-Z only.
_RUN = re.compile(rb"[a-z\xc0-\xff]+")
_VALUE = np.arange(256, dtype=np.int64) ** POWER


def runs_of(doc_id: int | None, text: str | None) -> Counter:
    """Words of a text as Latin-1 bytes, with how often they occur; one run of DAMAGED lacks a letter. A null id counts as empty."""
    found: Counter = Counter()
    if text:
        begun = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
        for run, n in Counter(_RUN.findall(text.encode("latin-1", "replace").lower())).items():
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begun)
            if h % DAMAGED == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += n
    return found


def _words(least: int):
    def out(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    for word, n in runs_of(doc_id, text).items():
                        if len(word) >= least:
                            seen[word] += n
                if len(seen) > KEPT:
                    yield out(seen)
                    seen = Counter()
        yield out(seen)

    return run


def _latin(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of a column of words, one byte each, and where each word starts (rows + 1)."""
    words = [w.encode("latin-1") for w in column.to_pylist()]
    return np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)]).astype(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their keys, and the keys less each of their letters."""
    for batch in batches:
        for part in slices(batch, "word"):
            raw, at = _latin(part.column("word"))
            row = np.repeat(np.arange(part.num_rows), np.diff(at))
            key = np.add.reduceat(_VALUE[raw], at[:-1]) if part.num_rows else np.zeros(0, np.int64)
            letters = np.unique((row << 8) | raw)
            less = key[letters >> 8] - _VALUE[letters & 255]
            ends = np.searchsorted(letters >> 8, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column("word"), part.column("n"), pa.array(key), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(less))], ["word", "n", "key", "less"])


#: What is left of a word without a letter: of exchanges by place, of longer words without it, and whole words for the latter.
_EXCHANGE, _LONGER, _WHOLE = 0, 1, 2
RESTS = "id long, kind int, less long, place int, rest long"


def _rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rests of words in linked classes, for the letters whose loss links them."""
    for batch in batches:
        for part in slices(batch, "word"):
            raw, at = _latin(part.column("word"))
            spans, rows = Spans(raw), part.num_rows
            row = np.repeat(np.arange(rows), np.diff(at))
            id_, key = (part.column(c).to_numpy() for c in ("id", "key"))
            less, place = key[row] - _VALUE[raw], np.arange(raw.size) - at[row]
            rest = spans.without(at[row], at[row + 1], np.arange(raw.size)).view(np.int64)
            new = np.ones(raw.size, bool)  # of equal neighbours the first: the others leave the same word
            new[1:] = (raw[1:] != raw[:-1]) | (row[1:] != row[:-1])
            for kind, column in ((_EXCHANGE, "exchanged"), (_LONGER, "removed")):
                lists = part.column(column)
                linked = np.zeros(raw.size, bool)
                values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum([x or 0 for x in lists.value_lengths().to_pylist()])])
                for r in np.flatnonzero(np.diff(ends)):
                    own = slice(at[r], at[r + 1])
                    linked[own] = np.isin(less[own], values[ends[r] : ends[r + 1]])
                k = np.flatnonzero(linked if kind == _EXCHANGE else linked & new)
                yield _rest_rows(id_[row[k]], kind, less[k], place[k], rest[k])
            k = np.flatnonzero(part.column("shorter").to_numpy(zero_copy_only=False).astype(bool))
            yield _rest_rows(id_[k], _WHOLE, key[k], np.zeros(k.size, np.int64), spans.whole(at[k], at[k + 1]).view(np.int64))


def _rest_rows(id_, kind: int, less, place, rest) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(id_), pa.array(np.full(id_.size, kind, np.int32)), pa.array(less), pa.array(place.astype(np.int32)), pa.array(rest)], ["id", "kind", "less", "place", "rest"])


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (id, other) of the words (id, word, n, key, less) that differ by one inserted, deleted or replaced letter, both ways
    round, with the other's word and n."""
    losses = words.select("key", F.explode("less").alias("less")).distinct()
    keys = words.select("key").distinct()
    exchanged = losses.join(losses.groupBy("less").agg(F.count("*").alias("classes")).filter("classes > 1"), "less", "left_semi")
    removed = losses.join(keys.select(F.col("key").alias("less")), "less", "left_semi")
    linked = exchanged.select("key", F.col("less").alias("exchanged"), F.lit(None).cast("long").alias("removed"), F.lit(False).alias("shorter"))
    linked = linked.unionByName(removed.select("key", F.lit(None).cast("long").alias("exchanged"), F.col("less").alias("removed"), F.lit(False).alias("shorter")))
    linked = linked.unionByName(removed.select(F.col("less").alias("key"), F.lit(None).cast("long").alias("exchanged"), F.lit(None).cast("long").alias("removed"), F.lit(True).alias("shorter")))
    # A class has at most as many losses as the alphabet has letters.
    linked = written(linked.groupBy("key").agg(F.collect_set("exchanged").alias("exchanged"), F.collect_set("removed").alias("removed"), F.max("shorter").alias("shorter")), "classes")
    rests = written(words.select("id", "word", "key").join(linked, "key").mapInArrow(_rests, RESTS), "rests")
    a, b = (rests.filter(F.col("kind") == _EXCHANGE).select(F.col("id").alias(x), "less", "place", "rest") for x in ("x", "y"))
    pairs = a.join(b, ["less", "place", "rest"]).filter("x < y").select("x", "y", "place", F.lit(_EXCHANGE).alias("kind"))
    longer = rests.filter(F.col("kind") == _LONGER).select(F.col("id").alias("x"), "less", "place", "rest")
    whole = rests.filter(F.col("kind") == _WHOLE).select(F.col("id").alias("y"), "less", "rest")
    pairs = pairs.unionByName(longer.join(whole, ["less", "rest"]).select("x", "y", "place", F.lit(_LONGER).alias("kind")))
    of = words.select("id", "word", "n")
    for c in ("x", "y"):
        pairs = pairs.join(of.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"), F.col("n").alias(f"{c}_n")), c)
    rest_of = lambda w: F.concat(F.expr(f"left({w}, place)"), F.expr(f"substr({w}, place + 2)"))
    same = F.when(F.col("kind") == _LONGER, rest_of("x_word") == F.col("y_word")).otherwise((F.length("x_word") == F.length("y_word")) & (rest_of("x_word") == rest_of("y_word")))
    pairs = pairs.filter(same)
    both = F.explode(F.array(F.struct(F.col("x").alias("id"), F.col("y").alias("other"), F.col("y_word").alias("word"), F.col("y_n").alias("n")), F.struct(F.col("y").alias("id"), F.col("x").alias("other"), F.col("x_word").alias("word"), F.col("x_n").alias("n"))))
    out = written(pairs.select(both.alias("p")).select("p.*").groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "word", "other")).alias("best")), "near-words")
    discard(linked, rests)
    return out


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The words of `docs` (doc_id, text) of LEAST letters that occur TWICE, each with its form (the near word that occurs most, if TIMES
    as often; of equally frequent ones the first in code-point order), the last of its forms, and its near words' number.

    Null and empty texts have no words; a null id counts as an empty one in the checksum; repeated rows count one by one; other columns
    are ignored; an empty table gives one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_words(LEAST), "word string, n long")
    counted = found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= TWICE)
    words = written(counted.mapInArrow(_keys, "word string, n long, key long, less array<long>").withColumn("id", F.monotonically_increasing_id()), "words")
    near = near_words(words)
    own = words.select("id", "word", "n").join(near, "id", "left")
    form = -F.col("best.n") >= TIMES * F.col("n")
    own = written(own.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(form, F.col("best.word")).alias("form"), F.when(form, -F.col("best.n")).alias("form_n"), F.when(form, F.col("best.other")).alias("last")), "forms")
    discard(near)
    most = own.agg(F.max("n")).first()[0] or TWICE
    steps = max(1, math.floor(math.log(most / TWICE, TIMES) + 1e-9))  # forms behind one another at most
    last = own.filter("last is not null").select("id", "last")
    for _ in range(math.ceil(math.log2(steps))):
        last = written(last.join(last.select(F.col("id").alias("last"), F.col("last").alias("next")), "last", "left").select("id", F.coalesce("next", "last").alias("last")), "roots")
    ends = last.join(words.select(F.col("id").alias("last"), F.col("word").alias("root")), "last").select("id", "root")
    return own.drop("last").join(ends, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
