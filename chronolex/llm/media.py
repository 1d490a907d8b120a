"""Interleaved document sequences with media columns.

``parse`` reads HTML into an ordered array of structs: text runs and media
references, each with its position, and for media the digest it points at and
the caption of its figure. ``store`` writes payloads as 8-bit grey PNG images,
one row per digest within a batch; ``load`` reads the stored bytes back,
decodes them and computes features. ``resolve`` joins references to stored
media by digest and returns them at their positions with their captions.

A digest that many documents share is split over SALTS parts before the join;
there are at most HOT_SHARE such digests, so their list can be broadcast.

Null text is empty text; an empty text is one row of padding; a very long text is
one image. Extra columns are ignored, and an empty table has no sequences. Null HTML parses
to an empty sequence. A reference without a stored payload keeps its row with
null media columns. Repeated rows and equal texts share one payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch, slices

WIDTH = 576
"""Samples in an image row; payloads are whole rows."""
PAD = 255
SALTS = 64
HOT_SHARE = 1000
"""A digest is hot when it has more than one in HOT_SHARE of all references."""
BLOCK = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "br", "section", "article", "figure", "ul", "ol", "table", "blockquote", "pre"}
MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "source"}
PREFIX = "digest:"


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.caption: list[str] | None = None
        self.figure: list[int] | None = None
        self.hidden = 0

    def flush(self):
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def end_caption(self):
        """The caption that is open belongs to the media of its figure; outside a figure it is text."""
        if self.caption is None:
            return
        text, self.caption = " ".join("".join(self.caption).split()), None
        for k in self.figure or []:
            self.items[k]["caption"] = text
        if self.figure is None and text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        if tag == "figure":
            self.end_caption()
        elif tag in BLOCK and self.caption is not None:
            self.caption.append(" ")
        if tag in MEDIA:
            self.flush()
            a = dict(attrs)
            src = a.get("src") or ""
            self.items.append({"kind": MEDIA[tag], "text": None, "digest": src.removeprefix(PREFIX) if src.startswith(PREFIX) else None, "caption": a.get("alt")})
            if self.figure is not None:
                self.figure.append(len(self.items) - 1)
        elif tag == "figcaption":
            self.end_caption()
            self.flush()
            self.caption = []
        elif tag in BLOCK:
            self.flush()
            if tag == "figure":
                self.figure = []

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag in BLOCK:
            if tag == "figure":
                self.end_caption()
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data):
        if not self.hidden:
            (self.run if self.caption is None else self.caption).append(data)


def sequence(html: str | None) -> list[dict]:
    """Items of one page in order, each with its position."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.end_caption()
    parser.flush()
    return [{"pos": k, **x} for k, x in enumerate(parser.items)]


ITEM = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])


def parse(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """``key`` and ``items``, an array of (pos, kind, text, digest, caption)."""

    def run(batches):
        for batch in batches:
            for part, _, _ in slices(batch, html):
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array([sequence(h) for h in part.column(html).to_pylist()], pa.list_(ITEM))], [key, "items"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, items array<struct<pos: int, kind: string, text: string, digest: string, caption: string>>")


def pad(raw: bytes) -> bytes:
    return raw + bytes([PAD]) * (-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """Whole rows of 8-bit grey samples as a PNG image."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """Samples of an image that ``to_png`` wrote; checks the sums of all chunks."""
    at, body = 8, b""
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        part = image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged image")
        body += part if kind == b"IDAT" else b""
        at += 12 + size
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(-1, WIDTH + 1)[:, 1:].tobytes()


def payload_digest(text):
    """sha256 of the padded payload of a text column."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    size = F.octet_length(raw)
    missing = F.when(size == 0, F.lit(WIDTH)).otherwise(F.pmod(-size, F.lit(WIDTH)))
    return F.sha2(F.concat(raw, F.unhex(F.repeat(F.lit(f"{PAD:02X}"), missing))), 256)


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """Stored media: digest of the payload, size without padding, image."""

    def run(batches):
        for batch in batches:
            for part, data, at in slices(batch, text):
                seen: dict[str, tuple[int, bytes]] = {}
                for k in range(part.num_rows):
                    raw = data[at[k] : at[k + 1]].tobytes()
                    payload = pad(raw)
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in seen:
                        seen[digest] = len(raw), to_png(payload)
                yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([n for n, _ in seen.values()], pa.int64()), pa.array([x for _, x in seen.values()], pa.binary())], ["digest", "n_bytes", "media"])

    return materialise(docs.select(text).mapInArrow(run, "digest string, n_bytes long, media binary"), "media")


def features(samples: np.ndarray) -> str:
    """Mean, deviation, and shares of eight equal ranges of 8-bit samples."""
    shares = np.bincount(samples >> 5, minlength=8) / max(len(samples), 1)
    return ";".join(f"{x:.6f}" for x in (samples.mean(), samples.std(), *shares))


FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def load(stored: DataFrame, tail: int = 32) -> DataFrame:
    """Read stored images back; what they hold and their features, one row per digest."""

    def run(batches):
        for batch in batches:
            out = []
            for digest, n, image in zip(batch.column("digest").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media"), strict=True):
                image = image.as_py()
                payload = from_png(image)
                out.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-tail:]), len(image), hashlib.sha256(image).hexdigest(), features(np.frombuffer(payload, np.uint8))))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in FEATURES.split(", ")])

    read = stored.mapInArrow(run, FEATURES)
    return read.groupBy("digest").agg(*[F.first(c).alias(c) for c in read.columns[1:]])


def resolve(sequences: DataFrame, media: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per media reference: ``key``, pos, kind, caption, digest and the columns of ``media``."""
    items = sequences.select(key, F.explode("items").alias("item")).select(key, "item.*").filter(F.col("kind") != "text").drop("text")
    counts = items.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.count("*").alias("n"))
    total = items.count()
    hot = F.broadcast(counts.filter(F.col("n") * HOT_SHARE > max(total, HOT_SHARE * HOT_SHARE)).select("digest", F.lit(True).alias("hot")))  # under HOT_SHARE rows
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(key, "pos"), F.lit(SALTS))).otherwise(0).cast("int")
    left = items.join(hot, "digest", "left").withColumn("salt", salt).drop("hot")
    copies = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    right = media.join(hot, "digest", "left").withColumn("salt", copies).drop("hot")
    return left.join(right, ["digest", "salt"], "left").drop("salt")


def report(docs: DataFrame) -> DataFrame:
    """Every document as a page with one figure, stored, parsed, resolved by digest and read back."""
    size = F.octet_length(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    page = F.concat(F.lit("<article><p>A text of "), size, F.lit(f' bytes.</p><figure><img src="{PREFIX}'), payload_digest(F.col("text")), F.lit('"><figcaption>Its '), size, F.lit(" bytes as samples.</figcaption></figure></article>"))
    pages = docs.select("doc_id", page.alias("html"))
    with scratch() as keep:
        media = materialise(load(store(docs)), "media-features")
        keep(media)
    # parsed once: the frequent digests are looked for in what the join then reads
    sequences = materialise(parse(pages, key="doc_id"), "sequences")
    found = resolve(sequences, media, "doc_id")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "caption", "pos")
