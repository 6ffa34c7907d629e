"""Token ids in shard files of compressed bit planes.

Documents are range-partitioned by doc_id and tokenised where they lie; each partition writes one file in
ascending doc_id order. A file is

    b"TWBP1\\n" | chunks | index (JSON, zstandard) | index length, unsigned 64-bit little-endian

A chunk holds at most CHUNK ids. Its ids are transposed into bit planes (plane p has bit p of every id,
eight ids a byte); planes that are zero in the whole chunk are left out, each other plane is compressed with
zstandard. The index names for each chunk its ids, its place and its planes' lengths, and for each document
its id and number of ids; documents may span chunks. Files are written under a name of the attempt and
renamed at the end, so a lost executor or a second attempt leaves no broken file. All paths go through
pyarrow's file systems; the folder must be one that driver and executors share.

Null and empty texts are the end id alone; texts of any length are written whole and may span chunks.
Repeated doc_ids are documents of their own, in order of a hash of their text; repeated rows are written each. A null
doc_id sorts first. An empty table writes no file and gives no rows. Extra columns are ignored, whatever
their names. The vocabulary's added tokens (an end mark, say): with `added_tokens`, as is the library's
default, their strings in a text become their ids; without it they are ordinary text.
"""

from __future__ import annotations

import json
import os
import struct
import sys
import uuid
import zlib
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded, buffers, new_path, staged

MAGIC, CHUNK, END_ID = b"TWBP1\n", 1 << 16, 2
KNOWN_BYTES, SHARD_BYTES = 128 << 20, 128 << 20
PIECE_BYTES = 192  # of a known piece beside its string: places in the dictionary and arrays
ENCODE_BYTES, GATHER = 1 << 20, 1 << 16  # text of a call to encode; pieces put together at once
_BLANK = np.array([i < 128 and chr(i).isspace() for i in range(256)])


def encode_chunk(ids: np.ndarray) -> tuple[bytes, list[int]]:
    """(bytes, length of each of 32 planes; 0: the plane is zero)."""
    import zstandard

    pack, out, sizes = zstandard.ZstdCompressor(level=3), [], []
    top = int(ids.max()).bit_length() if len(ids) else 0
    for p in range(32):
        plane = np.packbits((ids >> np.uint32(p)).astype(np.uint8) & 1) if p < top else np.zeros(0, np.uint8)
        out.append(pack.compress(plane.tobytes()) if plane.any() else b"")
        sizes.append(len(out[-1]))
    return b"".join(out), sizes


def decode_chunk(data: bytes, sizes: list[int], n: int) -> np.ndarray:
    import zstandard

    unpack, at = zstandard.ZstdDecompressor(), 0
    ids = np.zeros(n, np.uint32)
    for p, size in enumerate(sizes):
        if size:
            plane = np.frombuffer(unpack.decompress(data[at : at + size]), np.uint8)
            ids |= np.unpackbits(plane, count=n).astype(np.uint32) << np.uint32(p)
            at += size
    return ids


class ShardWriter:
    def __init__(self, sink):
        self.sink, self.at, self.parts, self.held = sink, len(MAGIC), [], 0
        self.chunks: list = []
        self.docs: list = []
        sink.write(MAGIC)

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append([doc_id, len(ids)])
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= CHUNK:
            ids = np.concatenate(self.parts)
            while len(ids) >= CHUNK:
                self._chunk(ids[:CHUNK])
                ids = ids[CHUNK:]
            self.parts, self.held = [ids], len(ids)

    def _chunk(self, ids) -> None:
        data, sizes = encode_chunk(ids)
        self.sink.write(data)
        self.chunks.append([len(ids), self.at, sizes])
        self.at += len(data)

    def close(self) -> None:
        import zstandard

        if self.held:
            self._chunk(np.concatenate(self.parts))
        index = zstandard.ZstdCompressor(level=3).compress(json.dumps({"chunks": self.chunks, "docs": self.docs}).encode())
        self.sink.write(index + struct.pack("<Q", len(index)))


def read_shard(source):
    """(doc_id, ids) of each document of a shard; a chunk and a document are held at a time."""
    import zstandard

    size = source.size()
    source.seek(size - 8)
    (n,) = struct.unpack("<Q", source.read(8))
    source.seek(size - 8 - n)
    index = json.loads(zstandard.ZstdDecompressor().decompress(source.read(n)))
    chunks = iter(index["chunks"])
    parts, have = [], 0
    for doc_id, count in index["docs"]:
        while have < count:
            k, at, sizes = next(chunks)
            source.seek(at)
            parts.append(decode_chunk(source.read(sum(sizes)), sizes, k))
            have += k
        ids = np.concatenate(parts) if len(parts) > 1 else parts[0]
        yield doc_id, ids[:count]
        parts, have = [ids[count:]], have - count


class Encoder:
    """The library's ids of whole texts, each distinct piece encoded once as long as it is remembered.

    Texts are cut before each blank, which stays with the piece that follows. The vocabulary's splitting pattern takes
    a single blank with what follows, so a cut there changes nothing; a text in which a blank touches other white space
    is encoded whole. Cutting, counting distinct pieces and putting ids together are array operations; Python sees
    each distinct piece of a call once.
    """

    def __init__(self, source: str, added_tokens: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(source)
        self.tok.encode_special_tokens = not added_tokens
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()] if added_tokens else []
        vocab = self.tok.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each id; a byte is a character in the vocabulary
        for token, i in vocab.items():
            self.width[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # place of a piece; one without a blank before it is the first of its text
        self.ids, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)  # ids of the piece in place i: ids[at[i] : at[i + 1]]
        self.hits = np.zeros(0, np.int64)
        self.held = 0  # bytes of all these

    def _learn(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(names, range(len(self.known), len(self.known) + len(names)), strict=True))
        self.ids = np.concatenate([self.ids, ids])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        self.hits = np.concatenate([self.hits, np.zeros(len(names), np.int64)])
        self.held += sum(map(sys.getsizeof, names)) + PIECE_BYTES * len(names) + ids.nbytes

    def _trim(self) -> None:
        """Keep the half of the pieces that were met most often."""
        keep = np.zeros(len(self.hits), bool)
        keep[np.argsort(self.hits, kind="stable")[(len(keep) + 1) // 2 :]] = True
        names, sizes, hits = list(compress(self.known, keep.tolist())), np.diff(self.at), self.hits[keep] // 2
        ids = self.ids[np.repeat(keep, sizes)]
        self._forget()
        self._learn(names, ids, sizes[keep])
        self.hits = hits
        if self.held > KNOWN_BYTES:
            self._forget()

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pieces that begin with a blank and end with none, encoded as one text; number of each piece's, by its bytes)."""
        (ids,) = self._library(["".join(pieces)])
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(lengths)) + 1
        return ids, np.diff(ends, prepend=0)

    def _places(self, words: pa.Array, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(place of each distinct piece, -1: not known; whether white space beside its blank or at its end forbids a cut)."""
        at = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        raw, offsets = buffers(words)
        odd = np.zeros(len(names), bool)
        fresh = np.flatnonzero(at < 0)
        begin, end = offsets[fresh], offsets[fresh + 1] - 1
        after = np.where(raw[begin] == 32, raw[np.minimum(begin + 1, end)], 65) if len(fresh) else np.zeros(0, np.uint8)
        odd[fresh] = _BLANK[after] | _BLANK[raw[end]]
        for i in fresh[((after | raw[end]) > 127) & ~odd[fresh]].tolist():
            odd[i] = names[i][-1].isspace() or names[i][0] == " " and names[i][1].isspace()
        return at, odd

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        if self.held > KNOWN_BYTES:
            self._trim()
        texts = texts.cast(pa.large_string()).fill_null("")
        raw, offsets = buffers(texts)
        raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
        mark = raw == 32
        mark[offsets[:-1][offsets[:-1] < len(raw)]] = True
        cuts = np.append(np.flatnonzero(mark), len(raw))
        bounds = np.searchsorted(cuts[:-1], offsets)  # each text's pieces
        coded = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(raw)]).dictionary_encode()
        piece, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        at, odd = self._places(coded.dictionary, names)

        whole = np.full(len(texts), any(" " in a for a in self.added))  # joined pieces could make such a string
        whole[np.searchsorted(bounds, np.flatnonzero(odd[piece]), side="right") - 1] = True
        for a in self.added:
            whole |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        cut = np.repeat(~whole, np.diff(bounds))
        met = np.bincount(piece[cut], minlength=len(names))

        fresh = np.flatnonzero((at < 0) & (met > 0))
        text, offsets = buffers(coded.dictionary)
        blank, lengths = text[offsets[fresh]] == 32, np.diff(offsets)
        order = np.concatenate([fresh[blank], fresh[~blank]])
        new = [names[i] for i in order.tolist()]
        ids, sizes, n = [], [], int(blank.sum())
        for lo in range(0, n, 512):
            hi = min(lo + 512, n)
            got, size = self._joined(new[lo:hi], lengths[order[lo:hi]])
            ids.append(got)
            sizes.append(size)
        firsts = self._library(new[n:])
        at[order] = np.arange(len(new)) + len(self.known)
        self._learn(new, np.concatenate([*ids, *firsts, np.zeros(0, np.uint32)]), np.concatenate([*sizes, [len(x) for x in firsts]]).astype(np.int64))
        self.hits[at[met > 0]] += met[met > 0]

        place = at[piece]
        begin = self.at[place]
        sizes = np.where(cut, self.at[place + 1] - begin, 0)
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        flat = np.empty(int(ends[-1]), np.uint32)
        for lo in range(0, len(place), GATHER):
            hi = min(lo + GATHER, len(place))
            flat[ends[lo] : ends[hi]] = self.ids[np.repeat(begin[lo:hi] - ends[lo:hi], sizes[lo:hi]) + np.arange(ends[lo], ends[hi])]
        where = ends[bounds].tolist()
        out = [flat[a:z] for a, z in zip(where[:-1], where[1:], strict=True)]
        asked = np.flatnonzero(whole)
        for i, ids in zip(asked.tolist(), self._library(texts.take(pa.array(asked)).to_pylist()), strict=True):
            out[i] = ids
        return out


@lru_cache(maxsize=2)
def encoder(source: str, added_tokens: bool) -> Encoder:
    return Encoder(source, added_tokens)


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, added_tokens: bool = False) -> DataFrame:
    """Writes docs(doc_id, text) to `folder`; returns (shard, file, first doc_id, docs, tokens) of each file."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        held = spark.sparkContext.broadcast(f.read())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES) if size < 1 << 60 else 1)  # beyond that Spark does not know the size
    # by id, then by text, then by place: an id that repeats in many rows is cut as well, and equal rows may lie in any order
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    ordered = docs.withColumns({"h": order[1], "at": order[2]}).repartitionByRange(shards, order[0], "h", "at").sortWithinPartitions(order[0], "h", "at").select("doc_id", "text")

    def run(batches):
        tok = writer = None
        fs, root = _file_system(folder)
        shard = TaskContext.get().partitionId()
        trial = f"{root}/.{shard:06d}-{uuid.uuid4().hex}"
        tokens = 0
        for batch in bounded(batches, 1, ENCODE_BYTES):
            if writer is None:
                tok = encoder(held.value, added_tokens)
                fs.create_dir(root)
                sink = fs.open_output_stream(trial)
                writer = ShardWriter(sink)
            for name, got in zip(batch.column(0).to_pylist(), tok.encode(batch.column(1)), strict=True):
                ids = np.append(got, np.uint32(end_id))
                tokens += len(ids)
                writer.add(name, ids)
        if writer is not None:
            writer.close()
            sink.close()
            final = f"{root}/shard-{shard:06d}.twbp"
            fs.move(trial, final)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [f"shard-{shard:06d}.twbp"], "docs": pa.array([len(writer.docs)], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

    return staged(ordered.mapInArrow(run, "shard int, file string, docs long, tokens long"), "shards")


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files that write_tokens lists."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    based = files.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))).repartition(max(files.count(), 1), "shard").select("file", "base")

    def run(batches):
        fs, root = _file_system(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[list] = [[], [], [], []]
                with fs.open_input_file(f"{root}/{name}") as source:
                    for doc_id, ids in read_shard(source):
                        for column, v in zip(rows, (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            column.append(v)
                        start += len(ids)
                        if len(rows[0]) == 10_000:
                            yield _table(rows)
                            rows = [[], [], [], []]
                yield _table(rows)

    return based.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _table(rows):
    return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def tokenise(docs: DataFrame, tokenizer: str, folder: str | None = None, added_tokens: bool = False) -> DataFrame:
    """Write the files, read them back, and say what each document got."""
    folder = folder or new_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer, added_tokens=added_tokens), folder)
