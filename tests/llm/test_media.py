"""Interleaved sequences: parsing, digests, read-back, alignment of positions and captions."""

import hashlib
import zlib

import duckdb
import pytest

from stratalens.llm import media as M
from stratalens.llm.oracles import MEDIA

PAGE = """<html><head><title>t</title><style>p{}</style></head><body><h1>Title &amp; more</h1><p>one <b>bold</b>
 two<br>three</p><script>var x = "<p>no</p>";</script><figure><img src="sha256:%s" alt="alt"><figcaption>The <i>caption</i></figcaption></figure>
<p>between</p><img src="sha256:%s" alt="  second   image "><img alt="no source"><video src="https://example.org/v.mp4" title="clip"></video><p>unclosed <em>end"""


def test_page_items():
    a, b = "a" * 64, "b" * 64
    assert M.page_items(PAGE % (a, b)) == [
        ["text", "Title & more", None, None], ["text", "one bold two", None, None], ["text", "three", None, None],
        ["media", None, f"sha256:{a}", "The caption"], ["text", "between", None, None], ["media", None, f"sha256:{b}", "second image"],
        ["media", None, "https://example.org/v.mp4", "clip"], ["text", "unclosed end", None, None],
    ]
    assert M.page_items(None) == M.page_items("") == M.page_items("<script>only</script>") == []
    assert M.page_items("<figure><figcaption>alone</figcaption></figure>") == [["text", "alone", None, None]]
    two = M.page_items("<figure><img src=1><img src=2><figcaption>both</figcaption></figure>")
    assert [x[3] for x in two] == ["both", "both"]


def _payload(text):
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % 192 or (0 if raw else 192))


TEXTS = [None, "", "a", "a ", "x" * 192, "x" * 193, "é北😀" * 70, "one\ntwo\n\n \nthree & <four>", "\n\t\r\f", "a" * 192, "big " * 300_000, "</p><img src='sha256:0'>"]


def test_documents_against_plain_python(spark):
    docs = spark.createDataFrame([(k, t, "c") for k, t in enumerate(TEXTS)] + [(None, "a", "c"), (2, "a", "c")], "doc_id long, text string, caption string").repartition(3)
    rows = M.document_media(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = TEXTS[r.doc_id] if r.doc_id is not None else "a"
        raw = _payload(text)
        stored = b"P6\n64 %d\n255\n" % (len(raw) // 192) + raw
        means = [sum(raw[c::3]) // (len(raw) // 3) for c in range(3)]
        feature = f"64x{len(raw) // 192} rgb {means[0]},{means[1]},{means[2]} range {min(raw)}-{max(raw)} distinct {len(set(raw))}"
        got = (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature)
        assert got == (len((text or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature)
        assert r.caption == f"{r.n_bytes} bytes" and r.position == sum(1 for x in (text or "").split("\n") if x.strip(" \t\f\r"))
    assert M.document_media(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = con.execute(MEDIA)
    names = [c[0] for c in found.description]
    rows = M.op12_interleaved_media(spark, sf)
    assert sorted(rows.columns) == sorted(names)
    assert sorted(map(str, rows.select(*names).toPandas().itertuples(index=False, name=None))) == sorted(map(str, found.fetchall()))


def test_interleave_keeps_positions_and_captions(spark):
    payloads = [_payload("first"), _payload("second")]
    digests = [hashlib.sha256(p).hexdigest() for p in payloads]
    stored = M.store(spark.createDataFrame([(bytearray(p),) for p in [*payloads, payloads[0]]], "payload binary"))
    pages = spark.createDataFrame([(1, PAGE % tuple(digests)), (2, PAGE % (digests[1], "0" * 64)), (2, None), (None, f'<img src="sha256:{digests[0]}">')], "page_id long, html string").repartition(2)
    rows = M.interleave(pages, stored, "page_id").collect()
    by = {r.page_id: r["items"] for r in rows if r["items"]}
    assert len(rows) == 4 and [] in [r["items"] for r in rows]
    assert [i.position for i in by[1]] == list(range(8))
    assert [(i.caption, i.media and i.media.payload_sha256) for i in by[1] if i.kind == "media"] == [("The caption", digests[0]), ("second image", digests[1]), ("clip", None)]
    assert [i.media and i.media.payload_sha256 for i in by[2] if i.kind == "media"] == [digests[1], None, None]
    assert by[None][0].media.payload_bytes == 192


def test_only_stored_images_are_read():
    with pytest.raises(ValueError):
        M.samples(b"P6\n64 2\n255\n" + b" " * 192)
