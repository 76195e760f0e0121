"""Interleaved document sequences: texts and media of a page in reading order, with payloads resolved by digest.

`parse` turns HTML into a page's ordered items: text runs and references to media, each with its position; a reference keeps the
caption that belongs to it (the caption of its figure, else its alternative text). `store` writes payloads as images named by the
digest of the payload; `describe` reads the stored bytes back; `resolve` joins references to what is stored, by digest. Payloads
stay where they are: only digests, positions, captions and what was computed from a payload are shuffled. `interleave` puts the
resolved media back into their sequences.

A stored payload is a binary portable pixel map, three 8-bit samples a pixel and WIDTH pixels a row, so payloads are whole rows of
ROW bytes.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm.storage import bounded_batches, derived, discard, table, written
from stratalens.llm.textbytes import slices

WIDTH = 64
ROW = 3 * WIDTH
#: References that name a payload by its digest.
SCHEME = "sha256:"
#: Elements whose content isn't text, elements that stand for a medium with the attribute that names it, and those that run on in a line.
HIDDEN = {"script", "style", "template", "noscript", "head"}
MEDIA = {"img": "src", "video": "src", "audio": "src", "source": "src", "embed": "src", "object": "data"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "dfn", "em", "i", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "u", "var", "wbr"}
ITEM = "struct<position: int, kind: string, text: string, ref: string, caption: string>"
_SPACE = re.compile(r"[ \t\n\f\r]+")


class _Page(HTMLParser):
    """Items of one page: ["text", text, None, None] or ["media", None, reference, caption]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self._text: list[str] = []
        self._hidden: list[str] = []
        self._figures: list[list[list]] = []
        self._caption: list[str] | None = None

    def _flush(self) -> None:
        if self._text:
            if text := _SPACE.sub(" ", "".join(self._text)).strip(" "):
                self.items.append(["text", text, None, None])
            self._text = []

    def handle_starttag(self, tag: str, attributes: list) -> None:
        if tag in HIDDEN:
            self._flush()
            self._hidden.append(tag)
        elif self._hidden:
            return
        elif tag in MEDIA:
            self._flush()
            found = dict(attributes)
            if ref := found.get(MEDIA[tag]):
                item = ["media", None, ref.strip(), _SPACE.sub(" ", found.get("alt") or found.get("title") or "").strip(" ") or None]
                self.items.append(item)
                if self._figures:
                    self._figures[-1].append(item)
        elif tag == "figure":
            self._flush()
            self._figures.append([])
        elif tag == "figcaption" and self._figures:
            self._flush()
            self._caption = []
        elif tag not in INLINE and self._caption is None:
            self._flush()

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            if tag in self._hidden:
                del self._hidden[self._hidden.index(tag) :]
        elif self._hidden:
            return
        elif tag == "figcaption" or tag == "figure":
            self._captioned()
            self._flush()
            if tag == "figure" and self._figures:
                self._figures.pop()
        elif tag not in INLINE and self._caption is None:
            self._flush()

    def _captioned(self) -> None:
        """A figure's caption goes to all its media; without any it stays as text."""
        if self._caption is not None:
            if text := _SPACE.sub(" ", "".join(self._caption)).strip(" "):
                for item in self._figures[-1] if self._figures else ():
                    item[3] = text
                if not self._figures or not self._figures[-1]:
                    self.items.append(["text", text, None, None])
            self._caption = None

    def handle_data(self, data: str) -> None:
        if not self._hidden:
            (self._text if self._caption is None else self._caption).append(data)

    def done(self) -> list[list]:
        self.close()
        self._captioned()
        self._flush()
        return self.items


def page_items(html: str | None) -> list[list]:
    """Kind, text, reference and caption of each item of a page, in reading order."""
    page = _Page()
    page.feed(html or "")
    return page.done()


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            each = [page_items(h) for h in part.column("html").to_pylist()]
            ends = np.cumsum([0, *map(len, each)])
            position = np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
            flat = [item for items in each for item in items]
            columns = [pa.array(position, pa.int32()), *[pa.array([item[k] for item in flat], pa.string()) for k in range(4)]]
            items = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["position", "kind", "text", "ref", "caption"]))
            kept = [k for k, name in enumerate(part.schema.names) if name != "html"]
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in kept], items], [*[part.schema.names[k] for k in kept], "items"])


def parse(pages: DataFrame) -> DataFrame:
    """`pages` with their items instead of `html`; null and empty pages have none. Other columns stay; one called items is replaced.

    Character references are resolved, white space is joined, empty runs are left out; scripts, styles and the head aren't text.
    Unclosed elements end with the page.
    """
    bounded_batches(pages.sparkSession)
    pages = pages.drop("items")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != "html"]
    return pages.mapInArrow(_sequences, ", ".join([*fields, f"items array<{ITEM}>"]))


def payload(text: str = "text") -> Column:
    """A text's UTF-8 bytes, filled up with spaces to whole rows, one at least; a null is empty."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rest = F.pmod(F.octet_length(raw), F.lit(ROW))
    missing = F.when((rest == 0) & (F.octet_length(raw) > 0), 0).otherwise(ROW - rest)
    return F.concat(raw, F.repeat(F.lit(" "), missing.cast("int")).cast("binary"))


def digest(of: Column) -> Column:
    return F.sha2(of, 256)


def store(payloads: DataFrame) -> DataFrame:
    """A written table (digest, media) of the payloads (binary, whole rows). Equal payloads have equal digests and media."""
    rows = F.expr(f"octet_length(payload) div {ROW}")
    header = F.concat(F.lit(f"P6\n{WIDTH} "), rows.cast("string"), F.lit("\n255\n")).cast("binary")
    return written(payloads.select(digest(F.col("payload")).alias("digest"), F.concat(header, F.col("payload")).alias("media")), "media")


def samples(media: bytes) -> np.ndarray:
    """The samples of a stored image: rows x WIDTH x 3."""
    kind, size, most, raw = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P6" or most != b"255" or len(raw) != 3 * width * height:
        raise ValueError("not a stored image")
    return np.frombuffer(raw, np.uint8).reshape(height, width, 3)


DESCRIBED = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(media: bytes) -> tuple[int, str, int, int, str, str]:
    image = samples(media)
    raw = image.tobytes()
    means = image.reshape(-1, 3).sum(0, dtype=np.int64) // (image.size // 3)
    held = np.flatnonzero(np.bincount(image.reshape(-1), minlength=256))
    feature = f"{image.shape[1]}x{image.shape[0]} rgb {means[0]},{means[1]},{means[2]} range {held[0]}-{held[-1]} distinct {held.size}"
    return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [field.split()[0] for field in DESCRIBED.split(", ")]
    for batch in batches:
        for part in slices(batch, "media"):
            each = list(zip(*[described(x) for x in part.column("media").to_pylist()], strict=True))
            yield pa.RecordBatch.from_arrays([part.column("digest"), *[pa.array(x, t) for x, t in zip(each, types, strict=True)]], names)


def describe(stored: DataFrame) -> DataFrame:
    """What the stored bytes hold, read back: a written table with one row a digest."""
    found = stored.mapInArrow(_described, DESCRIBED)
    rest = [c for c in found.columns if c != "digest"]
    return written(found.groupBy("digest").agg(F.min(F.struct(*rest)).alias("d")).select("digest", "d.*"), "described")


def references(sequences: DataFrame, *keep: str) -> DataFrame:
    """A row for each reference by digest: the kept columns, position, caption and digest."""
    found = sequences.select(*keep, F.explode(F.filter("items", lambda i: i.ref.startswith(SCHEME))).alias("i"))
    return found.select(*keep, "i.position", "i.caption", F.substring("i.ref", len(SCHEME) + 1, 64).alias("digest"))


def resolve(refs: DataFrame, known: DataFrame) -> DataFrame:
    """References with what is known of their payloads; those of unknown payloads have nulls. Many references may name one digest:
    `known` is a table with one row for each, so the join can be split where it is skewed."""
    return refs.join(known, "digest", "left")


def interleave(pages: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The items of each page, with `media` (what the stored bytes hold) for references by digest; null for texts, other references and
    unknown payloads. Repeated keys are told apart; pages without items keep an empty array."""
    sequences = written(parse(pages).withColumn("__row", F.monotonically_increasing_id()), "sequences")
    known = describe(stored)
    media = F.struct(*[c for c in known.columns if c != "digest"])
    found = resolve(references(sequences, "__row"), known).filter("payload_bytes is not null").groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("position", media))).alias("__media"))
    items = F.transform("items", lambda i: F.struct(i.position.alias("position"), i.kind.alias("kind"), i.text.alias("text"), i.ref.alias("ref"), i.caption.alias("caption"), F.try_element_at("__media", i.position).alias("media")))
    return derived(sequences.join(found, "__row", "left").select(key, items.alias("items")), sequences)


def document_pages(docs: DataFrame) -> DataFrame:
    """A page for each document: its lines as paragraphs, then its payload as a figure with the number of its bytes as caption."""
    text = F.coalesce("text", F.lit(""))
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    paragraphs = F.replace(text, F.lit("\n"), F.lit("</p><p>"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("string")
    figure = F.concat(F.lit(f'<figure><img src="{SCHEME}'), digest(payload()), F.lit('"><figcaption>'), size, F.lit(" bytes</figcaption></figure>"))
    return docs.select("doc_id", F.concat(F.lit("<article><p>"), paragraphs, F.lit("</p>"), figure, F.lit("</article>")).alias("html"))


def document_media(docs: DataFrame) -> DataFrame:
    """Each row of `docs` (doc_id, text) as an interleaved page whose figure holds the text: the figure's position and caption, and what
    its stored payload holds. Null and empty texts are one row of spaces; repeated rows count one by one, null ids stay, other columns
    are ignored, an empty table gives one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stored = store(docs.select(payload().alias("payload")))
    known = describe(stored)
    discard(stored)
    found = resolve(references(parse(document_pages(docs)), "doc_id"), known)
    size = F.split_part("caption", F.lit(" "), F.lit(1)).cast("long")
    return found.select("doc_id", size.alias("n_bytes"), *known.columns[1:], "position", "caption")


def op12_interleaved_media(spark, sf_dir: str) -> DataFrame:
    return document_media(table(spark, sf_dir, "documents"))
