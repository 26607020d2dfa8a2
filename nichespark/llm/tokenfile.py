"""Token-id files: independent zstandard frames with a trailing seek table and checksums.

A file is a valid zstandard stream. Data frames hold the ids of whole documents, one after the
other, little-endian. They are followed by a skippable frame with the directory of documents and
one with the seek table:

    frame*  DIRECTORY  SEEK_TABLE  PAD
    directory:  zstd(doc id int64, tokens uint32, null flags uint8 of every document), its documents, then its length (uint32 both)
    seek table: (compressed bytes, raw bytes, documents, low half of XXH64 of the raw bytes: uint32 each) per frame,
                then number of frames (uint32), bytes per id (uint8), MAGIC (uint32)

Spark's text writer is the sink, as it writes to any file system that Spark can; it ends each row with a
separator. So each frame is followed by PAD, a skippable frame of one byte, which is that separator.
"""

from __future__ import annotations

import gc
import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nichespark.runtime import new_path, settle

MAGIC = 0x8F92EAB1
SKIP_PAD, SKIP_DIRECTORY, SKIP_TABLE = 0x184D2A50, 0x184D2A5D, 0x184D2A5E
PAD = struct.pack("<II", SKIP_PAD, 1) + b"\n"
ENTRY = np.dtype([("packed", "<u4"), ("raw", "<u4"), ("docs", "<u4"), ("check", "<u4")])
#: A frame ends with the document that brings it to so many ids, a file after so many frames.
FRAME_IDS, FRAMES = 1 << 16, 255
#: Pieces and chunks that a worker remembers before it starts afresh, some 40 bytes each.
REMEMBERED = 800_000
#: Texts that are encoded at once, and their characters.
TEXTS, TEXT_CHARS = 4096, 6 << 20
#: The tokenizer's way of splitting. Texts of these characters lower-case and compose alike
#: everywhere, and PIECES cuts them in the same way.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PLAIN = re.compile("[ \\t\\n\\r\\x21-\\x7e\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff]*")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\\xdf-\\xf6\\xf8-\\xff]+|[0-9]|[^ \\t\\n\\ra-z0-9\\xdf-\\xf6\\xf8-\\xff]+")


def cuts_by_pieces(data: bytes) -> bool:
    """Whether PIECES cuts as a tokenizer file says; asked once, on the driver, as it takes much memory."""
    made = json.loads(data)
    steps = [x.get("type") for x in (made.get("normalizer") or {}).get("normalizers", [])]
    split = [x.get("pattern", {}).get("Regex") for x in (made.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    return steps == ["NFC", "Replace", "Lowercase"] and split[:1] == [SPLIT]


class Encoder:
    """Ids of whole texts by the tokenizers library; parts already seen are looked up.

    Texts are cut into chunks at white space, which the tokenizer's pattern never joins to what
    stands beside it. Each distinct chunk of a batch is looked up once; a new chunk of plain characters is cut into
    the pieces that the pattern makes, as these are fewer; new pieces, and new chunks of other texts, go to
    the library. Memory for what was seen is bounded.
    """

    def __init__(self, data: bytes, shortcut: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.shortcut = Tokenizer.from_str(data.decode("utf-8")), shortcut
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added, self.marks = re.compile("|".join(map(re.escape, added)) or "(?!)"), {x[:1] for x in added}
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.kind = pa.large_list(pa.uint16() if self.code == "H" else pa.uint32())
        self.keys, self.ids = pa.array([], pa.large_string()), pa.array([], self.kind)

    def _library(self, parts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for i in range(0, len(parts), 4096) for e in self.tokenizer.encode_batch_fast(parts[i : i + 4096], add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [array(self.code, x).tolist() for x in self.raw(texts)]

    def raw(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as machine integers of two or four bytes (see code)."""
        out: list[bytes] = [b""] * len(texts)
        plain, other = [], []
        for i, t in enumerate(texts):
            usual = self.shortcut and PLAIN.fullmatch(t) and not (any(m in t for m in self.marks) and self.added.search(t))
            (plain if usual else other).append(i)
        # characters that lower-case or split in other ways than the plain ones never meet them in a text
        for places, cut in ((plain, True), (other, False)):
            if not places:
                continue
            own = pa.array([texts[i].lower() if cut else texts[i].replace("\n", " ") for i in places], pa.large_string())
            words = pc.ascii_split_whitespace(own) if cut else pc.split_pattern(own, " ")
            coded = words.flatten().dictionary_encode()
            ids = self._chunks(coded.dictionary, cut).take(coded.indices)
            # chunks of a text, then ids of a text
            at = ids.offsets.to_numpy()[words.offsets.to_numpy() - words.offsets[0].as_py()]
            flat = ids.values.to_numpy()
            for i, a, b in zip(places, at[:-1].tolist(), at[1:].tolist(), strict=True):
                out[i] = flat[a:b].tobytes()
        return out

    def _lists(self, raw: list[bytes]) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64) // array(self.code).itemsize])
        return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), self.code)))

    def _chunks(self, chunks: pa.Array, plain: bool) -> pa.Array:
        """The ids of distinct chunks: of new ones by their pieces, which are remembered like chunks."""
        if len(self.keys) >= REMEMBERED:
            self.keys, self.ids = self.keys[:0], self.ids[:0]
        at = pc.index_in(chunks, value_set=self.keys)
        if at.null_count:
            new = chunks.filter(at.is_null()).to_pylist()
            cut = [PIECES.findall(c) for c in new] if plain else [[c] for c in new]
            parts = list(set().union(*cut))
            known = pc.index_in(pa.array(parts, pa.large_string()), value_set=self.keys)
            fresh = [p for p, k in zip(parts, known.is_null().to_pylist(), strict=True) if k]
            have = self.ids.take(known.drop_null())
            flat, ends = have.flatten().to_numpy(), np.cumsum(have.value_lengths().to_numpy()).tolist()
            pieces = dict(zip(fresh, self._library(fresh), strict=True))
            pieces.update(zip((p for p in parts if p not in pieces), (flat[i:j].tobytes() for i, j in zip([0, *ends], ends, strict=False)), strict=True))
            # a chunk that has nothing to cut is a piece
            joined = {c: b"".join(map(pieces.__getitem__, p)) for c, p in zip(new, cut, strict=True) if p != [c]}
            self.keys = pa.concat_arrays([self.keys, pa.array([*fresh, *joined], pa.large_string())])
            self.ids = pa.concat_arrays([self.ids, self._lists([*(pieces[p] for p in fresh), *joined.values()])])
            at = pc.index_in(chunks, value_set=self.keys)
        return self.ids.take(at)


@contextmanager
def no_cycles() -> Iterator[None]:
    """Without passes of the collector over what is remembered, where no cycles are made; as before at the end."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


@lru_cache(maxsize=1)
def _encoder(data: bytes, shortcut: bool) -> Encoder:
    return Encoder(data, shortcut)


def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch whose second column are texts, in parts of TEXTS rows and TEXT_CHARS bytes, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, min(at + TEXTS, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_CHARS, side="right"))))
        yield batch.slice(at, stop - at)
        at = stop


class FileWriter:
    """Packs documents into frames, and makes the end of the file."""

    def __init__(self, width: int, frame_ids: int = FRAME_IDS):
        self.width, self.frame_ids, self.held, self.held_ids = width, frame_ids, [], 0
        self.table: list[tuple[int, int, int, int]] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.zstd = zstandard.ZstdCompressor(level=1, write_checksum=True)

    def add(self, doc_id: int | None, ids: bytes) -> bytes | None:
        """A finished frame, if this document fills one. ids: little-endian, of the file's width."""
        self.ids.append(doc_id)
        self.counts.append(len(ids) // self.width)
        self.held.append(ids)
        self.held_ids += self.counts[-1]
        return self._frame() if self.held_ids >= self.frame_ids else None

    def _frame(self) -> bytes:
        raw = b"".join(self.held)
        packed = self.zstd.compress(raw)
        self.table.append((len(packed), len(raw), len(self.held), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.held_ids = [], 0
        return packed

    def end(self) -> list[bytes]:
        """The last frame, if any, and the directory with the seek table."""
        out = [self._frame()] if self.held else []
        ids = np.array([0 if x is None else x for x in self.ids], "<i8").tobytes()
        nulls = np.array([x is None for x in self.ids], np.uint8).tobytes()
        listed = self.zstd.compress(ids + np.array(self.counts, "<u4").tobytes() + nulls)
        listed += struct.pack("<II", len(self.ids), len(listed) + 8)
        table = np.array(self.table, ENTRY).tobytes() + struct.pack("<IBI", len(self.table), self.width, MAGIC)
        return [*out, struct.pack("<II", SKIP_DIRECTORY, len(listed)) + listed + struct.pack("<II", SKIP_TABLE, len(table)) + table]


class FileReader:
    """Reads a file's directory, and decompresses the frames of requested documents only."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        end = len(data) - len(PAD)
        frames, width, magic = struct.unpack_from("<IBI", data, end - 9)
        if magic != MAGIC or bytes(self.data[end:]) != PAD:
            raise ValueError("not a token file, or cut off")
        at = end - 9 - frames * ENTRY.itemsize
        self.kind, self.table = np.dtype(f"<u{width}"), np.frombuffer(data, ENTRY, frames, at)
        n, size = struct.unpack_from("<II", data, at - 16)
        raw = zstandard.ZstdDecompressor().decompress(bytes(self.data[at - 8 - size : at - 16]), max_output_size=13 * n + 1) if n else b""
        self.doc_ids = np.frombuffer(raw, "<i8", n)
        self.counts = np.frombuffer(raw, "<u4", n, 8 * n).astype(np.int64)
        self.nulls = np.frombuffer(raw, np.uint8, n, 12 * n).astype(bool)
        # data frames are followed by a pad each
        self.starts = np.cumsum(self.table["packed"].astype(np.int64) + len(PAD)) - self.table["packed"] - len(PAD)
        self.frame_of = np.repeat(np.arange(frames), self.table["docs"])

    def frame(self, i: int) -> np.ndarray:
        t = self.table[i]
        raw = zstandard.ZstdDecompressor().decompress(bytes(self.data[self.starts[i] : self.starts[i] + int(t["packed"])]), max_output_size=int(t["raw"]) + 1)
        if len(raw) != t["raw"] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != t["check"]:
            raise ValueError(f"frame {i} is damaged")
        return np.frombuffer(raw, self.kind)

    def documents(self, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(position in the file, ids) of the documents at the wanted positions (default: all)."""
        wanted = np.arange(len(self.counts)) if wanted is None else np.asarray(wanted)
        first = np.searchsorted(self.frame_of, np.arange(len(self.table)))
        for f in np.unique(self.frame_of[wanted]):
            ids, own = self.frame(int(f)), slice(int(first[f]), int(first[f]) + int(self.table["docs"][f]))
            ends = np.cumsum(self.counts[own])
            for p in wanted[self.frame_of[wanted] == f].tolist():
                stop = int(ends[p - own.start])
                yield p, ids[stop - int(self.counts[p]) : stop]


def write_token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 1, frame_ids: int = FRAME_IDS, frames: int = FRAMES) -> str:
    """Write the ids of all documents in ascending order of id_col (nulls first; equal ids by a hash of the text); the folder.

    Each whole text (null: empty) is encoded without added special tokens and end_id is appended.
    Documents are range-partitioned by (id, hash); a partition's files have `frames` frames each, of `frame_ids` ids or one longer document, so
    their size does not depend on the number of partitions. The files follow each other in the order of
    their names, in the shared folder. Repeated rows are written each; other columns
    are ignored; no rows leave a folder without documents. The vocabulary file is broadcast (of
    fixed size).
    """
    import public_tokenizers

    spark = docs.sparkSession
    with open(path or public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        data = f.read()
    shared, shortcut = spark.sparkContext.broadcast(data), cuts_by_pieces(data)
    del data
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoder(shared.value, shortcut)
        width = array(encoder.code).itemsize
        writer, end = FileWriter(width, frame_ids), end_id.to_bytes(width, "little")
        emit = lambda parts: pa.RecordBatch.from_arrays([pa.array([(p + PAD)[:-1] for p in parts], pa.binary())], names=["value"])
        with no_cycles():
            for whole in batches:
                for b in blocks(whole):
                    for d, ids in zip(b.column(0).to_pylist(), encoder.raw(b.column(1).to_pylist()), strict=True):
                        if frame := writer.add(d, ids + end):
                            yield emit([frame])
                        if len(writer.table) == frames:
                            yield emit(writer.end())
                            writer = FileWriter(width, frame_ids)
                    pa.default_memory_pool().release_unused()
            if writer.ids:
                yield emit(writer.end())

    folder = new_path(spark, "tokens")
    # the hash deals out rows that repeat an id; a text as key would come to the driver in the splitters' sample
    ordered = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", frames + 1).text(folder)
    return folder


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False, only: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, in the files' order; ids too if asked for.

    start: ids of all documents before it, over all files. ids_crc32: of the ids as little-endian
    unsigned 32-bit integers. With `only`, just the documents of these ids are given, and no other frame is
    decompressed than theirs. The checksum of every frame that is read is verified; a damaged or cut-off file raises.
    """
    kinds = "part int, file int, doc_id long, place long, n_tokens long, ids_crc32 long, total long" + ", ids array<int>" * with_ids
    names = ["part", "file", "doc_id", "place", "n_tokens", "ids_crc32", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                reader = FileReader(data.as_py())
                counts = reader.counts
                ahead, total = np.cumsum(counts) - counts, int(counts.sum())
                wanted = np.arange(len(counts)) if only is None else np.flatnonzero(np.isin(reader.doc_ids, only) & ~reader.nulls)
                # one row without a document tells the file's total
                yield _rows(names, with_ids, [(part, file, None, -1, 0, 0, total, [])])
                rows, held = [], 0
                for p, x in reader.documents(wanted):
                    rows.append((part, file, None if reader.nulls[p] else int(reader.doc_ids[p]), int(ahead[p]), len(x), zlib.crc32(x.astype("<u4").tobytes()), total, x.astype(np.int32) if with_ids else None))
                    held += len(x)
                    if len(rows) == 4096 or with_ids and held > 1 << 22:
                        yield _rows(names, with_ids, rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(names, with_ids, rows)

    part, file = (F.regexp_extract("path", r"part-(\d+)-.*-c(\d+)", i).cast("int").alias(n) for i, n in ((1, "part"), (2, "file")))
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select(part, file, "content")
    rows = settle(files.mapInArrow(run, kinds))
    # one row a file
    totals = rows.where("place = -1").select("part", "file", "total")
    before = totals.select("part", "file", (F.sum("total").over(Window.orderBy("part", "file")) - F.col("total")).alias("ahead"))
    found = rows.where("place >= 0").join(before, ["part", "file"])
    return found.withColumn("start", F.col("ahead") + F.col("place")).drop("ahead", "place", "part", "file", "total")


def _rows(names: list[str], with_ids: bool, rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5, *([pa.list_(pa.int32())] if with_ids else [])]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[*names, "ids"] if with_ids else names)
