"""Token ids in a bit-plane file format.

A chunk holds whole documents: their ids are cut into blocks of BLOCK ids, each block's ids are transposed into planes
(byte planes, or bit planes), and each plane is compressed with zstandard: high bytes of ids vary little, so their
planes shrink well. A chunk starts with a header and an index of its documents; the table of chunks stores the ids of
all chunks, so that a document is found without reading others."""

from __future__ import annotations

import re
import struct
import sys
import threading
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

BLOCK = 16_384
#: Ids after which a chunk is closed; a longer document has a chunk of its own.
CHUNK = 1 << 20
MAGIC = b"FPL1"
#: Magic, bytes an id, whether planes are of bits, documents, ids, ids of a block.
HEADER = struct.Struct("<4sBBIQI")
#: Words (white-space chunks of bytes) whose ids a worker keeps while it has such tasks: about 200 bytes each.
KEPT = 300_000
_LITTLE = sys.byteorder == "little"


def planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The byte planes (or bit planes) of ids, lowest first."""
    low = ids.astype(f"<u{ids.itemsize}").view(np.uint8).reshape(-1, ids.itemsize).T
    if not bits:
        return [np.ascontiguousarray(x).tobytes() for x in low]
    return [np.packbits(x >> b & 1, bitorder="little").tobytes() for x in low for b in range(8)]


def unplanes(parts: list[bytes], n: int, width: int, bits: bool) -> np.ndarray:
    out = np.zeros((n, width), np.uint8)
    for k, part in enumerate(parts):
        x = np.frombuffer(part, np.uint8)
        if bits:
            out[:, k // 8] |= np.unpackbits(x, bitorder="little", count=n) << (k % 8)
        else:
            out[:, k] = x
    return out.reshape(-1).view(f"<u{width}")


def pack(keys: list[int | None], parts: list[np.ndarray], width: int = 2, bits: bool = False, level: int = 1) -> bytes:
    """A chunk: header, document keys (with a null flag) and lengths, plane sizes, planes."""
    ids = np.concatenate(parts).astype(f"<u{width}") if parts else np.empty(0, f"<u{width}")
    press = zstandard.ZstdCompressor(level=level)
    body = [press.compress(p) for at in range(0, len(ids), BLOCK) for p in planes(ids[at : at + BLOCK], bits)]
    index = np.array([[0 if k is None else k, k is None, len(p)] for k, p in zip(keys, parts, strict=True)], "<i8").tobytes()
    sizes = np.array([len(x) for x in body], "<u4").tobytes()
    return b"".join([HEADER.pack(MAGIC, width, bits, len(keys), len(ids), BLOCK), index, sizes, *body])


def unpack(chunk: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """The documents of a chunk: keys and ids."""
    magic, width, bits, docs, n, block = HEADER.unpack_from(chunk)
    if magic != MAGIC:
        raise ValueError("not a chunk of token ids")
    at = HEADER.size
    index = np.frombuffer(chunk, "<i8", docs * 3, at).reshape(docs, 3)
    at += docs * 24
    each, blocks = width * (8 if bits else 1), -(-n // block)
    sizes = np.frombuffer(chunk, "<u4", blocks * each, at)
    at += blocks * each * 4
    open_, ids = zstandard.ZstdDecompressor(), []
    for b in range(blocks):
        parts = []
        for size in sizes[b * each : (b + 1) * each]:
            parts.append(open_.decompress(chunk[at : at + size]))
            at += int(size)
        ids.append(unplanes(parts, min(block, n - b * block), width, bool(bits)))
    whole = np.concatenate(ids) if ids else np.empty(0, f"<u{width}")
    return [None if gone else int(k) for k, gone, _ in index], np.split(whole, np.cumsum(index[:, 2])[:-1]) if docs else []


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """Characters up to U+00FF as the letters that byte-level models write for their UTF-8 bytes: a printable byte is
    itself, the others are numbered from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    letter = {b: chr(b) if b in shown else chr(next(other)) for b in range(256)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


_LETTERS = _byte_letters()
#: Words that normalising leaves alone but for case: printable ASCII and the Latin letters of the first 256 characters.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The tokenizer file's pieces within such a lower-cased word (fixed pattern, for these characters).
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class Words(dict):
    """Ids (as bytes) of words as bytes, where a tokenizer works as Encoder says; the first KEPT words stay, they hold
    the frequent ones. A word of plain characters is cut here and its new pieces go to the tokenizer's model; others go
    through all its steps."""

    def __init__(self, machine, kind: np.dtype):
        self.machine, self.model, self.kind = machine, machine.model, kind
        self.code = {2: "H", 4: "I"}[kind.itemsize]
        self.pieces: dict[str, bytes] = {}
        self.special = [t.content.lower() for t in machine.get_added_tokens_decoder().values()]

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes() if _LITTLE else np.array(ids, self.kind).tobytes()

    def piece(self, piece: str) -> bytes:
        out = self.packed([x.id for x in self.model.tokenize(piece.translate(_LETTERS))])
        if len(self.pieces) < KEPT:
            self.pieces[piece] = out
        return out

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters
            low = word.lower().decode()
            out = self.pieces.get(low) or self.piece(low)
        else:
            text = word.decode()
            low = text.lower()
            if _PLAIN.fullmatch(text) and not ("<" in low and any(x in low for x in self.special)):
                known = self.pieces.get
                out = b"".join([known(p) or self.piece(p) for p in _PIECES.findall(low)])
            else:
                out = self.packed(self.machine.encode(text, add_special_tokens=False).ids)
        if len(self) < KEPT:
            self[word] = out
        return out


class Encoder:
    """Ids of texts as bytes. Where `spaced` says that a tokenizer drops white space and case, never joins across white
    space, cuts words as _PIECES does and works on bytes (as its file's normalizer and pre_tokenizer say), the ids of
    the words between ASCII white space are kept and put together."""

    def __init__(self, path: str, spaced: bool, width: int):
        self.machine, self.kind = _tokenizer(path), np.dtype(f"<u{width}")
        self.kept = Words(self.machine, self.kind) if spaced else None

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.machine.encode_batch(texts, add_special_tokens=False)]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if self.kept is None:
            return self._whole([t.decode() for t in texts])
        get = self.kept.__getitem__
        return [b"".join(map(get, t.split())) for t in texts]


#: Seconds after which an idle worker forgets the words that it has kept.
IDLE = 20
_encoders: dict[tuple, Encoder] = {}
_idle: list[threading.Timer] = []


def _borrow(path: str, spaced: bool, width: int) -> Encoder:
    """The worker's encoder, with the words of its earlier tasks. A function of the module, so that tasks share the
    module's table and not a copy of it."""
    while _idle:
        _idle.pop().cancel()
    key = path, spaced, width
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def _give_back() -> None:
    timer = threading.Timer(IDLE, _encoders.clear)
    timer.daemon = True
    timer.start()
    _idle.append(timer)


def _encode(path: str, end: int | None, width: int, spaced: bool, bits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _borrow(path, spaced, width)
        part, seq = TaskContext.get().partitionId(), 0
        tail = b"" if end is None else end.to_bytes(width, "little")
        keys: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([held], pa.int64()), pa.array([pack(keys, parts, width, bits)], pa.binary())], ["part", "seq", "docs", "ids", "chunk"])

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                texts = [t or b"" for t in some.column(1).cast(pa.binary()).to_pylist()]
                for key, raw in zip(some.column(0).to_pylist(), encoder(texts), strict=True):
                    ids = np.frombuffer(raw + tail, f"<u{width}")
                    if keys and held + len(ids) > CHUNK:
                        yield out()
                        seq, keys, parts, held = seq + 1, [], [], 0
                    keys.append(key), parts.append(ids)
                    held += len(ids)
        if keys:
            yield out()
        _give_back()

    return run


def encode_chunks(df: DataFrame, tokenizer: str, end: int | None, id_col: str = "doc_id", text_col: str = "text", width: int = 2, spaced: bool = False, bits: bool = False) -> DataFrame:
    """(part, seq, docs, ids, chunk): the ids of every whole text, with `end` after each document, in ascending order of
    the id column (null first; ties by a hash of the text); chunk is a file-format chunk of whole documents.

    tokenizer: path of a tokenizers file that every executor has. width: bytes of an id. Null and empty texts have
    no ids but the end id. Repeated rows are written as often as they occur; other columns are ignored."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    order = ["id", F.xxhash64("text")]
    rows = rows.repartitionByRange("id").sortWithinPartitions(*order)
    return rows.mapInArrow(_encode(tokenizer, end, width, spaced, bits), "part long, seq long, docs long, ids long, chunk binary")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, chunk in zip(*(batch.column(k) for k in range(3)), strict=True):
            keys, parts = unpack(chunk.as_py())
            sizes = np.array([len(p) for p in parts], np.int64)
            crc = [zlib.crc32(p.astype("<u4").tobytes()) for p in parts]
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * n, pa.int64()), pa.array([seq.as_py()] * n, pa.int64()), pa.array(keys, pa.int64()), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["part", "seq", "id", "at", "n_tokens", "ids_crc32"])


def read_documents(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, decoded from the chunks: start is the number of ids before it.

    Chunk starts add up over the chunks of a part, and over parts (as many as the writer had tasks)."""
    index = chunks.select("part", "seq", "ids")
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = index.withColumn("c0", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    parts = index.groupBy("part").agg(F.sum("ids").alias("total"))
    first = parts.withColumn("p0", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "p0")
    rows = chunks.select("part", "seq", "chunk").mapInArrow(_decode, "part long, seq long, id long, at long, n_tokens long, ids_crc32 long")
    places = starts.join(first, "part").select("part", "seq", (F.col("c0") + F.col("p0")).alias("s"))
    return rows.join(places, ["part", "seq"]).select(F.col("id").alias(id_col), (F.col("s") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest, read back from the files of all documents' ids."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chunks = encode_chunks(docs, public_tokenizers.path("word_bpe_49k.json"), end=2, spaced=True)
    return read_documents(Scratch(spark, "tokens").save(chunks, "chunks"))
