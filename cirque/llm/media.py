"""Media columns: interleaved document sequences whose media references resolve by digest.

``parse`` turns HTML into one ordered array of structs: runs of text, and references to media with the digest they
name and the caption that belongs to them. ``store`` puts payloads into a lossless 8-bit grey image (PGM, 64 samples a
row), one for each distinct payload; ``read_back`` takes samples out of stored bytes and computes their features.
``resolve`` joins references to what is known of their payload by digest, the stored media themselves or their features;
sequences keep their order, and a digest that nobody stored leaves nulls. In ``payload_features`` the media are written to
the shared folder and read from there, and only features cross the join.

Results for odd rows: null or empty HTML has an empty sequence; a null text is an empty payload, which is stored as 64
zeros; equal texts give equal rows; rows that repeat or share an id have a row each; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ROW = 64
ITEM = "position int, kind string, text string, digest string, caption string"
#: Elements that end a run of text.
BREAKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
SILENT = frozenset(("script", "style", "template", "noscript"))
MEDIA = frozenset(("img", "video", "audio", "source", "embed"))


class Sequence(HTMLParser):
    """Collects text and media references in the order of the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.silent: list[str] = []
        self.figure: list[dict] | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent.append(tag)
        if tag in BREAKS:
            self.flush()
        if tag in MEDIA:
            a = dict(attrs)
            link = a.get("src") or ""
            digest = a.get("data-digest") or (link[7:] if link.startswith("sha256:") else None)
            if link or digest:
                self.flush()
                self.items.append({"kind": "media", "text": link or None, "digest": digest, "caption": a.get("alt") or None})
                if self.figure is not None:
                    self.figure.append(self.items[-1])
        if tag == "figure":
            self.figure = []
        if tag == "figcaption":
            self.caption = []

    def handle_endtag(self, tag):
        if self.silent and tag == self.silent[-1]:
            self.silent.pop()
        if tag in BREAKS:
            self.flush()
        if tag == "figcaption" and self.caption is not None:
            words = " ".join("".join(self.caption).split())
            self.caption = None
            for item in self.figure or []:
                item["caption"] = words or item["caption"]
        if tag == "figure":
            self.figure = None

    def handle_data(self, data):
        if not self.silent:
            (self.run if self.caption is None else self.caption).append(data)


def sequence(html: str | None) -> list[dict]:
    p = Sequence()
    p.feed(html or "")
    p.close()
    p.flush()
    return [{"position": i} | x for i, x in enumerate(p.items)]


def parse(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``items`` (array of position, kind, text, digest, caption) in place of the HTML."""
    C.prepare(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (html, "items")]
    item = pa.struct([("position", pa.int32()), *((k, pa.string()) for k in ("kind", "text", "digest", "caption"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, html, 4 << 20):
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array([sequence(x) for x in b.column(html).to_pylist()], pa.list_(item))], names=[*kept, "items"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*kept).schema.fields), f"items array<struct<{', '.join(x.replace(' ', ':', 1) for x in ITEM.split(', '))}>>"])
    return pages.select(*kept, html).mapInArrow(run, schema)


def to_media(payload: bytes) -> bytes:
    """A PGM image of the payload and zeros up to a positive multiple of 64."""
    body = payload + bytes(ROW if not payload else -len(payload) % ROW)
    return b"P5\n%d %d\n255\n" % (ROW, len(body) // ROW) + body


def from_media(media: bytes) -> bytes:
    """The samples of such an image."""
    kind, size, depth, body = media.split(b"\n", 3)
    wide, high = map(int, size.split())
    if kind != b"P5" or depth != b"255" or len(body) != wide * high:
        raise ValueError("not an 8-bit PGM image")
    return body


def feature(samples: bytes) -> str:
    """Rows, least, greatest, mean and deviation of the samples, and the entropy of their values in bits."""
    x = np.frombuffer(samples, np.uint8)
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    return f"rows={len(x) // ROW};min={x.min()};max={x.max()};mean={x.mean():.4f};std={x.std():.4f};entropy={float(-(p * np.log2(p)).sum()):.4f}"


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """digest (of the unpadded payload) and media: a stored image for each text; equal ones are equal rows."""
    C.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, text, 4 << 20):
            got = [(x or "").encode() for x in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(x).hexdigest() for x in got], pa.string()), pa.array([len(x) for x in got], pa.int64()), pa.array([to_media(x) for x in got], pa.binary())], names=["digest", "n_bytes", "media"])

    return docs.select(text).mapInArrow(run, "digest string, n_bytes long, media binary")


def read_back(stored: DataFrame) -> DataFrame:
    """digest, n_bytes and what is read from the stored bytes, one row for each digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = b.column("media").to_pylist()
            body = [from_media(x) for x in media]
            sha = lambda x: hashlib.sha256(x).hexdigest()
            columns = [b.column("digest"), b.column("n_bytes"), *(pa.array([f(x) for x in body]) for f in (len, sha, lambda x: zlib.crc32(x[-ROW:]))), *(pa.array([f(x) for x in media]) for f in (len, sha)), pa.array([feature(x) for x in body], pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(pa.int64()) if pa.types.is_integer(c.type) else c for c in columns], names=FEATURES)

    kinds = ["string", "long", "long", "string", "long", "long", "string", "string"]
    got = stored.mapInArrow(run, ", ".join(map(" ".join, zip(FEATURES, kinds, strict=True))))
    return got.groupBy("digest").agg(*(F.first(c).alias(c) for c in FEATURES[1:]))


FEATURES = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """``sequences`` exploded to a row for each item, with the columns of ``media`` for those that refer to any.

    References to one digest are dealt into as many parts as there are shuffle partitions, and ``media`` goes to the parts
    that hold any reference: however many rows name a digest, no task gets them all. ``sequences`` is read twice.
    """
    parts = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flat = sequences.withColumn("item", F.explode("items")).drop("items").select("*", "item.*").drop("item")
    plain = [f.name for f in flat.schema.fields if f.dataType.typeName() not in ("map", "array", "struct", "variant")]
    flat = flat.withColumn("_deal", F.pmod(F.xxhash64(*plain), F.lit(parts)).cast("int"))
    known = flat.select("digest", "_deal").where("digest is not null").distinct().join(media, "digest")
    return flat.join(known, ["digest", "_deal"], "left").drop("_deal")


def document_pages(docs: DataFrame) -> DataFrame:
    """doc_id and a page that shows the document's payload as a captioned figure, named by its digest."""
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select("doc_id", F.concat(F.lit("<p>document "), name, F.lit("</p><figure><img src=\"sha256:"), digest, F.lit("\"><figcaption>payload of "), name, F.lit("</figcaption></figure>")).alias("html"))


def payload_features(docs: DataFrame) -> DataFrame:
    """doc_id and the features of each whole text's stored payload, by way of parse, store (written), read_back and resolve."""
    with C.Steps(docs.sparkSession) as steps:
        pages = steps(parse(document_pages(docs)), "pages")
        media = steps(store(docs), "media")
        got = resolve(pages, steps(read_back(media), "payloads")).where("kind = 'media'")
        return steps.keep(got.select("doc_id", *FEATURES[1:], "position", "caption"), "features")
