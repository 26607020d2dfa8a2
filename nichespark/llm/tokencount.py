"""Token counts: pieces counted once per distinct pre-token, joined to documents' frequencies."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The character by which the model writes a space.
MARK = "▁"
#: A block ends at so many documents or characters.
BLOCK_DOCS, BLOCK_CHARS = 4096, 1 << 24
#: Bytes of texts for each bucket; a bucket's messages are about two thirds of that.
BUCKET_BYTES = 1 << 26
RUNS = re.compile(" ( *[^ ]*)")


@lru_cache(maxsize=1)
def _model(proto: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=proto)


def pre_tokens(text: str) -> list[str]:
    """Pieces of text that merges never join: each is encoded as if it were a text of its own.

    The model puts a space before a text, writes spaces as MARK and has no piece in which a MARK
    follows another character. So a text may be cut ahead of every run of spaces, the first
    space of which stands for the one put before a text.
    """
    if MARK in text:
        text = text.replace(MARK, " ")
    parts = text.split(" ")
    if "" not in parts:
        return parts
    runs = RUNS.findall(" " + text)
    if not runs[-1]:  # one space at the end, or no text; the model puts no space before an empty text
        runs.pop()
        if runs:
            runs[-1] += " "
    return runs


def check_model(proto: bytes) -> None:
    """Raise if the model has a piece that would make pre_tokens wrong."""
    sp = _model(proto)
    for i in range(sp.get_piece_size()):
        if re.search(f"[^{MARK}]{MARK}", sp.id_to_piece(i)):
            raise ValueError("a piece of this model goes beyond a pre-token")
    if sp.encode("a  b") != sp.encode("a") + sp.encode(" b"):
        raise ValueError("this model changes white space")


def _pack(words: list[bytes], of: np.ndarray, doc: np.ndarray, times: np.ndarray) -> bytes:
    """Words with their postings; of: how many postings each word has."""
    lens = np.fromiter(map(len, words), np.uint32, len(words))
    head = np.array([len(words), len(doc)], np.uint32)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), lens.tobytes(), of.astype(np.uint32).tobytes(), doc.astype(np.uint16).tobytes(), times.astype(np.uint32).tobytes(), *words]))


def _unpack(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    w, n = np.frombuffer(raw, np.uint32, 2).tolist()
    lens, of = np.frombuffer(raw, np.uint32, w, 8), np.frombuffer(raw, np.uint32, w, 8 + 4 * w)
    at = 8 + 8 * w
    doc, times = np.frombuffer(raw, np.uint16, n, at), np.frombuffer(raw[at + 2 * n : at + 6 * n], np.uint32)
    ends = (np.cumsum(lens, dtype=np.int64) + at + 6 * n).tolist()
    return [raw[a:b] for a, b in zip([at + 6 * n, *ends[:-1]], ends, strict=True)] if w else [], of, doc, times


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, buckets: int | None = None) -> DataFrame:
    """id_col, n_bytes (UTF-8), n_tokens of every whole text, as the SentencePiece model gives them.

    Documents are taken in blocks. A block makes its distinct pre-tokens and their frequency in each
    document, and deals them by hash into buckets, a packed row each. A bucket has every
    occurrence of its pre-tokens: it counts the pieces of each distinct one once, joins them to
    the frequencies and sums by document; the sums of all buckets are added per block. No ids of
    a document are made. A frequent word comes to its bucket once per block, so there is no hot
    key. buckets: by default one for each BUCKET_BYTES of texts, 96 at least. Each is a partition of its
    own, so tasks stay at some 50 MB for any input.

    The model file is read on the driver and broadcast (its size doesn't depend on the data).
    Null and empty texts have 0 bytes and tokens. Repeated rows, null ids and other columns are
    no trouble; no rows give no rows.
    """
    import public_tokenizers

    spark = docs.sparkSession
    with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        proto = f.read()
    check_model(proto)
    shared = spark.sparkContext.broadcast(proto)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    id_kind = rows.schema["id"].dataType.simpleString()
    n_buckets = buckets or max(96, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES + 1)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            texts, ids = [t or "" for t in batch.column(0).to_pylist()], batch.column(1)
            at = 0
            while at < len(texts):
                stop, chars = at, 0
                while stop < len(texts) and stop - at < BLOCK_DOCS and (stop == at or chars + len(texts[stop]) <= BLOCK_CHARS):
                    chars += len(texts[stop])
                    stop += 1
                own = texts[at:stop]
                seen: dict[str, int] = {}
                flat, lens = [], []
                for t in own:
                    p = pre_tokens(t)
                    lens.append(len(p))
                    flat += [seen.setdefault(x, len(seen)) for x in p]
                code = (np.array(flat, np.int64) << 16) | np.repeat(np.arange(len(own)), lens)
                del flat
                code, times = np.unique(code, return_counts=True)
                of = np.bincount(code >> 16, minlength=len(seen))
                words = [w.encode("utf-8", "surrogatepass") for w in seen]
                to = np.fromiter((zlib.crc32(w) % n_buckets for w in words), np.int64, len(words))
                order = np.argsort(to, kind="stable")
                start = np.cumsum(of) - of
                key = (part << 32) | block
                out = []
                for group in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                    n = of[group]
                    spot = np.repeat(start[group] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    out.append((int(to[group[0]]), _pack([words[i] for i in group.tolist()], n, code[spot] & 0xFFFF, times[spot])))
                head = pa.RecordBatch.from_arrays([ids.slice(at, stop - at), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in own], pa.int64())], names=["id", "n"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, head.schema) as w:
                    w.write_batch(head)
                out.append((zlib.crc32(str(key).encode()) % n_buckets, sink.getvalue().to_pybytes()))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([key] * len(out), pa.int64()), pa.array([False] * (len(out) - 1) + [True]), pa.array([p for _, p in out], pa.binary())], names=["bucket", "block", "is_head", "packed"])
                at, block = stop, block + 1

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        sp, known = _model(shared.value), {}
        parts = [(b, _unpack(p)) for b, h, p in zip(pdf["block"], pdf["is_head"], pdf["packed"], strict=True) if not h]
        for _, (words, *_) in parts:
            for w in words:
                known.setdefault(w, len(known))
        pieces = np.zeros(len(known), np.int64)
        names = list(known)
        for i in range(0, len(names), 20_000):
            pieces[i : i + 20_000] = [len(x) for x in sp.encode([w.decode("utf-8", "surrogatepass") for w in names[i : i + 20_000]], num_threads=1)]
        out = []
        for block, (words, of, doc, times) in parts:
            each = pieces[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]
            sums = np.bincount(doc, weights=np.repeat(each, of) * times.astype(np.float64)).astype(np.uint64)
            out.append((block, False, zstandard.ZstdCompressor(level=1).compress(sums.tobytes())))
        heads = pdf[pdf["is_head"]]
        out += list(zip(heads["block"], heads["is_head"], heads["packed"], strict=True))
        return pd.DataFrame(out, columns=["block", "is_head", "packed"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pa.ipc.open_stream(pdf.loc[pdf["is_head"], "packed"].iloc[0]).read_all()
        total = np.zeros(head.num_rows, np.int64)
        for p in pdf.loc[~pdf["is_head"], "packed"]:
            s = np.frombuffer(zstandard.ZstdDecompressor().decompress(p), np.uint64).astype(np.int64)
            total[: len(s)] += s
        return pd.DataFrame({id_col: head.column("id").to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get), "n_bytes": head.column("n").to_numpy(), "n_tokens": total})

    sums = rows.mapInArrow(emit, "bucket int, block long, is_head boolean, packed binary").repartition(n_buckets, "bucket").groupBy("bucket").applyInPandas(join, "block long, is_head boolean, packed binary")
    return sums.groupBy("block").applyInPandas(add, f"`{id_col}` {id_kind}, n_bytes long, n_tokens long")
