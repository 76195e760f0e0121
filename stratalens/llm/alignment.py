"""Alignment of two tokenizers over the same bytes, and how often their ids are linked in the corpus.

A text is encoded by a byte-level vocabulary (A) and by a vocabulary of pieces (B); byte offsets where tokens of both end cut the two
sequences into groups, and the last tokens of a group are linked. Documents are read once: their own columns, their pair
multiplicities and the pairs' local sums go to one written table. Multiplicities are posting blocks: the (B id, A id, document, times)
of up to CHUNK links, sorted, dealt to buckets by B id. Pair sums are added up by an ordinary aggregation first. Then both are
cogrouped by bucket: a bucket's pair sums beside its postings, from streams that Spark has sorted and may spill. There a B id's highest
count is found locally, every posting meets its pair's count, and what it adds to its document is sent on and summed by document.

No group grows without bound: a bucket with more than GROUP postings (a frequent B id) is split by blocks, and its pair sums, at most
one for each two ids of the vocabularies, go to every split. Contributions are at most BUCKETS rows a document.

Words are encoded apart and remembered (KEPT of them at most) where that can't change a result: a space behind a character that isn't
white space starts a pre-token of A, and no piece of B has its mark behind another character. Other texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.storage import bounded_batches, discard, table, written
from stratalens.llm.textbytes import slices

BYTES_FILE, PIECES_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose tokens a task remembers; links that a task gathers before it writes their blocks; documents in a block.
KEPT, CHUNK, CHUNK_DOCS = 300_000, 1 << 20, 1 << 16
#: Groups of B ids, and postings in one cogrouped group.
BUCKETS, GROUP = 64, 1 << 22
#: Pre-tokens of byte-level vocabularies of this kind (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_MARK = "▁"
#: A space at an end of the text or behind white space: words can't be taken apart there.
_JOINED = re.compile(r"\A | \Z|\s ")


def byte_ranks(path: str) -> dict[bytes, int]:
    """Ids of a byte-level vocabulary by their bytes: printable Latin-1 characters stand for themselves, the other bytes for the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    with open(path, encoding="utf-8") as file:
        return {bytes(byte_of[c] for c in token): id_ for token, id_ in json.load(file)["model"]["vocab"].items()}


class Encoders:
    """Both tokenizers, the bytes of their ids, and the tokens of words seen before."""

    def __init__(self, a_path: str = BYTES_FILE, b_path: str = PIECES_FILE):
        import sentencepiece
        import tiktoken

        ranks = byte_ranks(a_path)
        self.a = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = {i: x for x, i in ranks.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.apart = not any(_MARK in p.lstrip(_MARK) for p in pieces)
        a_size = max(self.a_bytes) + 1
        if a_size > 1 << 16 or len(pieces) > 1 << 15:
            raise ValueError("ids of A must fit into 16 bits, those of B into 15")
        self.a_length = np.array([len(self.a_bytes.get(i, b"")) for i in range(a_size)], np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], np.int64)
        self._a: dict[str, bytes] = {}
        self._b: dict[str, bytes] = {}
        self._odd: set[str] = set()

    def _encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes, bool]]:
        """Ids of each text behind a space, and whether both sides give its bytes back."""
        for text, ids in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            whole = b" " + text.encode()
            of_a = self.a.encode_ordinary(" " + text)
            same = b"".join(map(self.a_bytes.__getitem__, of_a)) == whole and b"".join(map(self.b_bytes.__getitem__, ids)) == whole
            yield array("H", of_a).tobytes(), array("H", ids).tobytes(), same

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """The 16-bit ids of A and B of each text; none where the text is empty or either side's bytes aren't the text's."""
        split = [t.split(" ") if t and self.apart and _MARK not in t and not _JOINED.search(t) else None for t in texts]
        if len(self._a) > KEPT:
            self._a, self._b, self._odd = {}, {}, set()
        new = list({w for words in split if words for w in words if w not in self._a})
        for w, (a, b, same) in zip(new, self._encode(new), strict=True):
            self._a[w], self._b[w] = a, b
            if not same:
                self._odd.add(w)
        out = []
        for text, words in zip(texts, split, strict=True):
            if words:
                same = not self._odd or self._odd.isdisjoint(words)
                out.append((b"".join(map(self._a.__getitem__, words)), b"".join(map(self._b.__getitem__, words))) if same else (b"", b""))
            elif text:
                a, b, same = next(self._encode([text]))
                out.append((a, b) if same else (b"", b""))
            else:
                out.append((b"", b""))
        return out


class Aligner:
    """Groups and links of the texts of a slice, all at once."""

    def __init__(self, encoders: Encoders):
        self.encoders = encoders
        ids = [str(i) for i in range(1 << 16)]
        self._strings = [f"{i}{end}" for end in (",", "|", ";") for i in ids]

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of A, of B, groups and the groups' digest for each text; A id, B id and text number of each link, in order."""
        coded = self.encoders.encode(texts)
        n_a, n_b = (np.array([len(x[k]) // 2 for x in coded], np.int64) for k in (0, 1))
        a, b = (np.frombuffer(b"".join(x[k] for x in coded), np.uint16).astype(np.int64) for k in (0, 1))
        end_a, end_b = np.cumsum(self.encoders.a_length[a]), np.cumsum(self.encoders.b_length[b])
        mark = np.zeros((end_a[-1] if end_a.size else 0) + 1, np.uint8)
        mark[end_a] |= 1
        mark[end_b] |= 2
        last_a, last_b = mark[end_a] == 3, mark[end_b] == 3
        of_a, of_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        text_of = np.searchsorted(np.cumsum(n_a), of_a, "right")
        groups = np.bincount(text_of, minlength=len(texts))
        # A group's A tokens come first: each token's place is its own number and that of the other side's tokens before it.
        place_a = np.arange(a.size) + np.concatenate([[0], of_b + 1])[np.cumsum(last_a) - last_a]
        place_b = np.arange(b.size) + np.concatenate([of_a + 1, [0]])[np.cumsum(last_b) - last_b]
        order = np.empty(a.size + b.size, np.int64)
        order[place_a] = a + (last_a.astype(np.int64) << 16)
        order[place_b] = b + (last_b.astype(np.int64) << 17)
        digests, at = [], [0, *accumulate((n_a + n_b).tolist())]
        for start, end in zip(at, at[1:], strict=False):
            digests.append(hashlib.sha256("".join(map(self._strings.__getitem__, order[start:end].tolist()))[:-1].encode()).hexdigest() if end > start else "")
        return n_a, n_b, groups, digests, a[of_a], b[of_b], text_of


SCHEMA = "kind int, row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, bucket int, size long, blob binary, pair long, n long"
_DOCUMENT, _BLOCK, _PAIR = 0, 1, 2
_TYPES = {"kind": pa.int32(), "row": pa.int64(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "groups_sha256": pa.string(), "bucket": pa.int32(), "size": pa.int64(), "blob": pa.binary(), "pair": pa.int64(), "n": pa.int64()}


def _rows(count: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(count, t) for k, t in _TYPES.items()], list(_TYPES))


def pack(b: np.ndarray, a: np.ndarray, doc: np.ndarray, times: np.ndarray) -> bytes:
    """A posting block: its columns behind one another."""
    return b"".join(x.astype(kind).tobytes() for x, kind in ((b, "<u2"), (a, "<u2"), (doc, "<u2"), (times, "<u4")))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(blob) // 10
    b, a, doc = (np.frombuffer(blob, "<u2", n, 2 * n * k).astype(np.int64) for k in range(3))
    return b, a, doc, np.frombuffer(blob, "<u4", n, 6 * n).astype(np.int64)


def _blocks(base: int, keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The posting blocks and pair sums of a chunk of links; a key holds bucket, B id, A id and the document's number in the chunk."""
    key, times = np.unique(np.concatenate(keys), return_counts=True)
    if not key.size:
        return
    pair = (key >> 16) & 0x7FFFFFFF
    edges = np.searchsorted(key >> 47, np.arange(BUCKETS + 1))
    full = [(k, edges[k], edges[k + 1]) for k in range(BUCKETS) if edges[k] < edges[k + 1]]
    blobs = [pack(pair[s:e] >> 16, pair[s:e] & 0xFFFF, key[s:e] & 0xFFFF, times[s:e]) for _, s, e in full]
    yield _rows(len(full), kind=[_BLOCK] * len(full), row=[base] * len(full), bucket=[k for k, _, _ in full], size=[int(e - s) for _, s, e in full], blob=blobs)
    starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    yield _rows(starts.size, kind=np.full(starts.size, _PAIR, np.int32), pair=pair[starts], n=np.add.reduceat(times, starts))


def _read(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(Encoders(a_path, b_path))
        base = first = TaskContext.get().partitionId() << 40
        keys: list[np.ndarray] = []
        for batch in batches:
            for part in slices(batch):
                count = part.num_rows
                if sum(map(len, keys)) > CHUNK or base - first + count > CHUNK_DOCS:
                    yield from _blocks(first, keys)
                    keys, first = [], base
                n_a, n_b, groups, digests, a, b, text_of = aligner.align(part.column("text").to_pylist())
                yield _rows(count, kind=[_DOCUMENT] * count, row=np.arange(base, base + count), doc_id=part.column("doc_id"), n_a=n_a, n_b=n_b, n_groups=groups, groups_sha256=digests)
                keys.append(((b % BUCKETS) << 47) | (b << 32) | (a << 16) | (text_of + (base - first)))
                base += count
        if keys:
            yield from _blocks(first, keys)

    return run


def contributions(pairs: pa.Table, blocks: pa.Table) -> pa.Table:
    """What the postings of a group add to their documents, given the sums of all pairs of the group's B ids."""
    order = np.argsort(pairs["pair"].to_numpy())
    pair, n = pairs["pair"].to_numpy()[order], pairs["n"].to_numpy()[order]
    starts = np.flatnonzero(np.concatenate([[True], (pair[1:] >> 16) != (pair[:-1] >> 16)]))[: pair.size]
    best = np.repeat(np.maximum.reduceat(n, starts), np.diff([*starts, pair.size])) == n if pair.size else n
    out: list[list[np.ndarray]] = [[], [], []]
    for base, blob in zip(blocks["row"].to_pylist(), blocks["blob"], strict=True):
        b, a, doc, times = unpack(blob.as_buffer())
        at = np.searchsorted(pair, (b << 16) | a)
        sums = np.zeros((3, int(doc.max()) + 1), np.int64)
        for k, x in enumerate((times, times * best[at], times * n[at])):
            np.add.at(sums[k], doc, x)
        held = np.flatnonzero(sums[0])
        for k, x in enumerate((held + base, sums[1][held], sums[2][held])):
            out[k].append(x)
    return pa.table({name: np.concatenate(x) if x else np.zeros(0, np.int64) for name, x in zip(("row", "n_best", "count_sum"), out, strict=True)})


def align(docs: DataFrame, a_path: str = BYTES_FILE, b_path: str = PIECES_FILE, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """For each row of `docs` (doc_id, text) its tokens, groups, links and the corpus-wide counts of its links; and the count of every
    linked pair of ids (b, a, n, best: whether no A id is linked to b more often).

    Null and empty texts, and texts that a side doesn't give back byte for byte, have zeros and an empty digest. Repeated rows count
    one by one, null ids stay, ties for the highest count are all highest, other columns are ignored, an empty table gives empty ones.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    read = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_read(a_path, b_path), SCHEMA), "alignment")
    counts = read.filter(F.col("kind") == _PAIR).groupBy("pair").agg(F.sum("n").alias("n"))
    counts = written(counts.withColumn("bucket", (F.shiftright("pair", 16) % BUCKETS).cast("int")), "alignment-pairs")
    blocks = read.filter(F.col("kind") == _BLOCK).select("row", "bucket", "size", "blob")
    # At most BUCKETS rows.
    splits = F.broadcast(blocks.groupBy("bucket").agg((F.lit(1) + F.floor(F.sum("size") / group)).cast("int").alias("splits")))
    left = counts.join(splits, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("salt"), "pair", "n")
    right = blocks.join(splits, "bucket").select("bucket", F.pmod(F.xxhash64("row"), F.col("splits")).cast("int").alias("salt"), "row", "blob")
    added = left.groupBy("bucket", "salt").cogroup(right.groupBy("bucket", "salt")).applyInArrow(lambda x, y: contributions(x, y), "row long, n_best long, count_sum long")
    sums = added.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    own = read.filter(F.col("kind") == _DOCUMENT).select("row", "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "groups_sha256")
    none = F.lit(0).cast("long")
    out = written(own.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256"), "aligned")
    discard(read)
    ids = counts.select(F.shiftright("pair", 16).alias("b"), F.col("pair").bitwiseAND(0xFFFF).alias("a"), "n")
    highest = ids.groupBy("b").agg(F.max("n").alias("__highest"))
    return out, ids.join(highest, "b").select("b", "a", "n", (F.col("n") == F.col("__highest")).alias("best"))


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))[0]
