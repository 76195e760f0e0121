"""Token counts under a unigram model, by dynamic programming over a trie of the corpus's distinct pre-tokens.

A pre-token is a word [^\\x20\\x09-\\x0D]+ behind the word mark; white space between words counts for nothing else. The best
segmentation of a prefix depends on the prefix alone. So the distinct pre-tokens of all documents are gathered by a shuffle,
dealt out by ranges of their order and sorted: each task walks the subtree of its range depth first, keeps the forward scores of
the current path, and computes only what lies below the branch point, so a shared prefix is scored once for the whole corpus
(once more for each range boundary that cuts through it). Terminals store the number of tokens of the best segmentation.

Documents then add up the terminals of their words: those of the HOT most frequent pre-tokens, a table of bounded size, where the
documents are read, all others by a join on the pre-token, which by then has no hot key.

The vocabulary is a public one; its pieces get Zipf log-probabilities by their ids (its own scores are merge ranks, no
probabilities, and tokenizers aren't trained here). Characters that no piece covers fall back to one token for each UTF-8 byte.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.storage import bounded_batches, collect_garbage, discard, table, written
from stratalens.llm.textbytes import slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Distinct pre-tokens that a task counts before it passes them on. Results don't depend on it.
KEPT = 200_000
#: Pre-tokens, of at most so many bytes, whose terminals are sent to all executors: 32 MB at most.
HOT, HOT_BYTES = 1 << 17, 1 << 8


def load(path: str = VOCABULARY) -> tuple[dict[str, float], float]:
    """Pieces with their log-probabilities, and that of a byte token."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    total = math.log(sum(1 / (i + 1) for i in range(n)))
    plain = {model.id_to_piece(i): -math.log(i + 1) - total for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    bytes_ = [i for i in range(n) if model.is_byte(i)]
    return plain, -math.log(max(bytes_, default=n) + 1) - total


class Walk:
    """A depth-first walk of a trie, given by its sorted words; the forward scores of the current path stay between calls."""

    def __init__(self, pieces: dict[str, float], byte_score: float):
        self.pieces, self.byte_score = pieces, byte_score
        self.longest = max(map(len, pieces), default=1)
        self.path, self.score, self.count = "", [0.0], [0]

    def tokens(self, words: list[str]) -> list[int]:
        """Tokens in the best segmentation (highest score, then fewest tokens) of each of the distinct, sorted `words`."""
        out, path, score, count = [], self.path, self.score, self.count
        get, byte_score, longest = self.pieces.get, self.byte_score, self.longest
        for word in words:
            # Branch point: what the last word's path shares with this one.
            shared = 0
            for a, b in zip(path, word):  # noqa: B905
                if a != b:
                    break
                shared += 1
            del score[shared + 1 :], count[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                n = len(word[i - 1].encode("utf-8", "surrogatepass"))
                best, least = score[i - 1] + n * byte_score, count[i - 1] + n
                for j in range(max(0, i - longest), i):
                    s = get(word[j:i])
                    if s is not None:
                        s += score[j]
                        if s > best or (s == best and count[j] + 1 < least):
                            best, least = s, count[j] + 1
                score.append(best)
                count.append(least)
            out.append(count[-1])
            path = word
        self.path = path
        return out


def count_tokens(words: list[str], pieces: dict[str, float], byte_score: float) -> list[int]:
    """Tokens of each of the distinct, sorted `words`."""
    return Walk(pieces, byte_score).tokens(words)


def words_of(texts: pa.Array) -> Iterator[list[bytes]]:
    """The words of each text, in UTF-8: of bytes, white space is \\x20 and \\x09-\\x0D alone."""
    return (t.split() if t else [] for t in texts.cast(pa.binary()).to_pylist())


def _strings(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pre-tokens with their counts, added up over as much of a task as fits."""

    def out(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_strings(list(found)), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    seen: Counter = Counter()
    for batch in batches:
        for part in slices(batch):
            for words in words_of(part.column("text")):
                seen.update(words)
            if len(seen) > KEPT:
                yield out(seen)
                seen = Counter()
    yield out(seen)


def _terminals(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(*shared.value)
        for batch in batches:
            for part in slices(batch, "word"):
                yield pa.RecordBatch.from_arrays([part.column("word"), part.column("n"), pa.array(walk.tokens([MARK + w for w in part.column("word").to_pylist()]), pa.int64())], ["word", "n", "tokens"])

    return run


DOCUMENTS = "doc_id long, n_pretokens long, n_distinct long, hot long, rest array<struct<word: string, times: long>>"


def _documents(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in slices(batch):
                sizes, distinct, hot, ends, rare, times = [], [], [], [0], [], []
                for words in words_of(part.column("text")):
                    counts, total = Counter(words), 0
                    for w, n in counts.items():
                        if (tokens := known.get(w)) is None:
                            rare.append(w)
                            times.append(n)
                        else:
                            total += tokens * n
                    sizes.append(len(words))
                    distinct.append(len(counts))
                    hot.append(total)
                    ends.append(len(rare))
                flat = pa.StructArray.from_arrays([_strings(rare), pa.array(times, pa.int64())], ["word", "times"])
                columns = [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, distinct, hot)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pretokens", "n_distinct", "hot", "rest"])

    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, hot: int = HOT) -> DataFrame:
    """Pre-tokens, distinct pre-tokens and tokens of each row of `docs` (doc_id, text).

    Null and empty texts have none; repeated rows are counted one by one; other columns are ignored; an empty table gives one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = spark.sparkContext.broadcast(load(vocabulary))  # a vocabulary: tens of thousands of pieces
    words = docs.mapInArrow(_distinct, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    terminals = written(words.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(_terminals(model), "word string, n long, tokens long"), "terminals")
    collect_garbage(spark)
    often = terminals.filter(F.octet_length("word") <= HOT_BYTES).orderBy(F.desc("n"), "word").limit(hot).select("word", "tokens").collect()
    known = spark.sparkContext.broadcast({r.word.encode(): r.tokens for r in often})
    each = written(docs.mapInArrow(_documents(known), DOCUMENTS).withColumn("row", F.monotonically_increasing_id()), "token-documents")
    rare = each.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.times").join(terminals.select("word", "tokens"), "word")
    sums = rare.groupBy("row").agg(F.sum(F.col("times") * F.col("tokens")).alias("rare"))
    out = written(each.drop("rest").join(sums, "row", "left").select("doc_id", "n_pretokens", "n_distinct", (F.col("hot") + F.coalesce("rare", F.lit(0))).alias("n_tokens")), "tokens")
    discard(terminals, each)
    model.unpersist()
    known.unpersist()
    return out


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
