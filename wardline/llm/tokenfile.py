"""Token ids in binary files of fixed-width bit packing.

A file holds the ids of many documents in a row: the blocks, then an index (the key of each document, its end as a count of
ids, the byte offset of each block), then a trailer.  An id takes the least number of bits that the vocabulary needs; a block
holds a fixed number of ids and begins at a whole byte, so any id is found by arithmetic and any block is unpacked by
numpy at once.  A writer holds one open block and the index.
"""

from __future__ import annotations

import os
import struct
import uuid
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .words import range_hashes, slices, text_bytes

MAGIC = b"TOKPACK2"
BLOCK = 4096
#: Text bytes of one file (a row counts ROW_BYTES more), and the most ranges of a run; beyond it ranges hold several files.
FILE_BYTES, ROW_BYTES, MOST_RANGES = 32 << 20, 32, 1 << 16
#: Bytes of the words and ids that a task remembers, and the longest word among them.
STORE_BYTES, LONGEST_STORED = 32 << 20, 40
#: Text bytes that a task encodes at a time; a longer single text is cut at blanks.
ENCODED_BYTES = 1 << 20
#: Words of letters alone that are encoded as one text, with this digit between them, and such texts of one call.
JOINED, BETWEEN, CALL = 100, "0", 100
#: Marks that end a word; this kind of tokenizer splits them from a letter before them.
_TAIL = r"(\pL)([.,;:!?$%&*#]+)(?: |$)"
_TRAILER = "<IIQQQ8s"
#: The key of a document without one.
NO_KEY = -(1 << 63)
#: Ids that a reader unpacks at a time; a longer document is read alone.
READ_IDS = 1 << 20


def bits_for(vocabulary: int) -> int:
    """Bits of the largest id of a vocabulary of that size."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids side by side, the lowest bit first, filled up to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    plane = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(plane.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    """The first n ids."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


class TokenWriter:
    """Writes ids and ends of documents to an open file."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.open = np.zeros(0, np.uint32)
        self.keys, self.ends, self.offsets = array("q"), array("Q"), array("Q", [0])
        self.n = 0

    def ids(self, ids: np.ndarray) -> None:
        """More ids of the document that is open."""
        self.n += len(ids)
        ids = np.concatenate([self.open, ids])
        full = len(ids) // self.block * self.block
        for k in range(0, full, self.block):
            self._put(ids[k : k + self.block])
        self.open = ids[full:].copy()

    def _put(self, ids: np.ndarray) -> None:
        self.offsets.append(self.offsets[-1] + self.out.write(pack(ids, self.bits)))

    def end(self, keys, ends) -> None:
        """Documents end, as counts of ids in the file."""
        self.keys.extend(keys)
        self.ends.extend(ends)

    def close(self) -> None:
        """Write the last block, the index and the trailer."""
        if len(self.open):
            self._put(self.open)
        for part in (self.keys, self.ends, self.offsets):
            self.out.write(np.frombuffer(part, f"<{'i' if part.typecode == 'q' else 'u'}8").tobytes() if len(part) else b"")
        self.out.write(struct.pack(_TRAILER, self.bits, self.block, self.n, len(self.keys), len(self.offsets) - 1, MAGIC))


class TokenFile:
    """Random access to a file that is open for reading at any place."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        if size < struct.calcsize(_TRAILER):
            raise ValueError("not a file of packed token ids")
        self.bits, self.block, self.n_ids, self.n_docs, n_blocks, magic = struct.unpack(_TRAILER, self._bytes(size - struct.calcsize(_TRAILER), struct.calcsize(_TRAILER)))
        if magic != MAGIC:
            raise ValueError("not a file of packed token ids")
        at = size - struct.calcsize(_TRAILER) - 8 * (n_blocks + 1)
        self.offsets = np.frombuffer(self._bytes(at, 8 * (n_blocks + 1)), "<u8").astype(np.int64)
        at -= 8 * self.n_docs
        self.ends = np.frombuffer(self._bytes(at, 8 * self.n_docs), "<u8").astype(np.int64)
        at -= 8 * self.n_docs
        self.keys = np.frombuffer(self._bytes(at, 8 * self.n_docs), "<i8")

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids from ``first`` up to, not including, ``last``."""
        if last <= first:
            return np.zeros(0, np.uint32)
        low, high = first // self.block, (last - 1) // self.block + 1
        data = self._bytes(int(self.offsets[low]), int(self.offsets[high] - self.offsets[low]))
        out = []
        for k in range(low, high):
            n = min(self.block, self.n_ids - k * self.block)
            at = self.offsets[k] - self.offsets[low]
            out.append(unpack(data[at : at + self.offsets[k + 1] - self.offsets[k]], self.bits, n))
        return np.concatenate(out)[first - low * self.block : last - low * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every range in a row."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class WordStore:
    """Ids of words, found by hash and compared byte by byte; emptied when it would exceed its bytes."""

    def __init__(self, limit: int = STORE_BYTES):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.hash, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.words, self.word_ends = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.id_ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.hash)

    @property
    def bytes(self) -> int:
        return sum(x.nbytes for x in (self.hash, self.slot, self.words, self.word_ends, self.ids, self.id_ends))

    def find(self, data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The slot of each word, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        place = np.searchsorted(self.hash, hashes)
        hit = np.flatnonzero(place < len(self.hash))
        hit = hit[self.hash[place[hit]] == hashes[hit]]
        slot = self.slot[place[hit]]
        size = offsets[hit + 1] - offsets[hit]
        same = size == self.word_ends[slot + 1] - self.word_ends[slot]
        hit, slot, size = hit[same], slot[same], size[same]
        unlike = data[spread(offsets[hit], size)] != self.words[spread(self.word_ends[slot], size)]
        differ = np.zeros(len(hit), bool)
        differ[np.repeat(np.arange(len(hit)), size)[unlike]] = True
        out[hit[~differ]] = slot[~differ]
        return out

    def add(self, data, offsets, hashes, ids, starts, sizes) -> None:
        """Words that were not found; of several with one hash the first is kept."""
        hashes, first = np.unique(hashes, return_index=True)
        place = np.searchsorted(self.hash, hashes)
        clash = np.zeros(len(hashes), bool)
        inside = place < len(self.hash)
        clash[inside] = self.hash[place[inside]] == hashes[inside]
        length = offsets[first + 1] - offsets[first]
        keep = ~clash & (length <= LONGEST_STORED)
        hashes, first, place, length = hashes[keep], first[keep], place[keep], length[keep]
        new = 16 + int(length.sum() + 4 * sizes[first].sum() + 32 * len(first))
        if self.bytes + new > self.limit and len(self):
            self.clear()
            place = np.zeros(len(hashes), np.int64)
        if new > self.limit:
            return
        self.slot = np.insert(self.slot, place, len(self.word_ends) - 1 + np.arange(len(first)))
        self.hash = np.insert(self.hash, place, hashes)
        self.words = np.concatenate([self.words, data[spread(offsets[first], length)]])
        self.word_ends = np.concatenate([self.word_ends, self.word_ends[-1] + np.cumsum(length)])
        self.ids = np.concatenate([self.ids, ids[spread(starts[first], sizes[first])]])
        self.id_ends = np.concatenate([self.id_ends, self.id_ends[-1] + np.cumsum(sizes[first])])


class WordEncoder:
    """Ids of texts by a tokenizers file, remembered by blank-separated words.

    ``separable`` says that the tokenizer lowers case, splits at blanks and line ends, which it drops, and splits
    punctuation and digits from letters, as this one does; otherwise whole texts are encoded.
    """

    def __init__(self, tokenizer_json: str, separable: bool = True, store_bytes: int = STORE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.separable = separable
        self.store = WordStore(store_bytes)
        self.between = self._ids([BETWEEN])[0]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words in a row, with the start and size of each; words of letters alone go many at a time, as no letter gives the id of a digit."""
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        out, at = [], 0
        letters = [k for k, w in enumerate(words) if w.isalpha()] if len(self.between) == 1 else []
        alone = sorted(set(range(len(words))).difference(letters))
        groups = [letters[k : k + JOINED] for k in range(0, len(letters), JOINED)]
        for k in range(0, len(groups), CALL):
            call = groups[k : k + CALL]
            for group, ids in zip(call, self._ids([f" {BETWEEN} ".join([words[w] for w in g]) for g in call]), strict=True):
                cuts = np.flatnonzero(ids == self.between[0])
                if len(cuts) != len(group) - 1:
                    alone += group
                    continue
                ends = np.append(cuts, len(ids))
                begin = np.concatenate([[0], cuts + 1])
                starts[group], sizes[group] = at + begin, ends - begin
                out.append(ids)
                at += len(ids)
        for k in range(0, len(alone), CALL * JOINED):
            some = alone[k : k + CALL * JOINED]
            found = self._ids([words[w] for w in some])
            sizes[some] = [len(x) for x in found]
            starts[some] = at + np.cumsum(sizes[some]) - sizes[some]
            out += found
            at += int(sizes[some].sum())
        return np.concatenate([*out, np.zeros(0, np.uint32)]), starts, sizes

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and n + 1 bounds."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.separable:
            found = [x for k in range(0, len(texts), CALL) for x in self._ids(texts[k : k + CALL].to_pylist())]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
            return np.concatenate([*found, np.zeros(0, np.uint32)]), bounds
        texts = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), _TAIL, r"\1 \2 ")
        words = pc.split_pattern(texts, " ")
        bounds = np.asarray(words.offsets).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        # words in capitals go by their lower form
        plain = pc.if_else(pc.ascii_is_alpha(coded.dictionary), pc.ascii_lower(coded.dictionary), coded.dictionary).dictionary_encode()
        data, offsets = text_bytes(plain.dictionary)
        hashes = range_hashes(np.concatenate([data, np.zeros(8, np.uint8)]), offsets[:-1], offsets[1:])
        slot = self.store.find(data, offsets, hashes)
        known, new = np.flatnonzero(slot >= 0), np.flatnonzero(slot < 0)
        ids, starts, sizes = np.zeros(0, np.uint32), np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
        starts[known] = self.store.id_ends[slot[known]]
        sizes[known] = self.store.id_ends[slot[known] + 1] - starts[known]
        ids = self.store.ids
        if len(new):
            more, begin, size = self._new(plain.dictionary.take(pa.array(new)).to_pylist())
            starts[new], sizes[new] = len(ids) + begin, size
            ids = np.concatenate([ids, more])
        order = plain.indices.to_numpy()[coded.indices.to_numpy()]
        each = sizes[order]
        out = ids[spread(starts[order], each)]
        if len(new):
            ends = offsets[new + 1] - offsets[new]
            fresh = np.concatenate([[0], np.cumsum(ends)])
            self.store.add(data[spread(offsets[new], ends)], fresh, hashes[new], ids, starts[new], sizes[new])
        return out, np.concatenate([[0], np.cumsum(each)])[bounds - bounds[0]]

    def encode(self, texts: list[str] | pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with the end id, and the end of each."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
        ids, bounds = self.flat(texts)
        return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds[1:] + 1 + np.arange(len(texts))

    def pieces(self, text: pa.Array, size: int = ENCODED_BYTES) -> list[pa.Array]:
        """One text as several whose ids in a row are its ids."""
        data, offsets = text_bytes(text)
        if not self.separable or offsets[-1] <= 2 * size:
            return [text]
        blanks = np.flatnonzero(data == 0x20)
        after = np.searchsorted(blanks, np.arange(size, int(offsets[-1]), size))
        cuts = np.unique(blanks[after[after < len(blanks)]])
        bounds = np.concatenate([[0], cuts, offsets[-1:]])
        return [pa.array([data[a:b].tobytes().decode()], pa.large_string()) for a, b in zip(bounds, bounds[1:], strict=False)]


def _open(uri: str):
    filesystem, path = pyarrow.fs.FileSystem.from_uri(uri)
    return filesystem, path


def _uri(path: str) -> str:
    return path if "://" in path else "file:///" + path.removeprefix("file:").lstrip("/")


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_json: str,
    vocabulary: int,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    separable: bool = True,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Encodes all documents and writes their ids in ascending id order into files below ``path``, a shared folder.

    Returns a table of the files in their order: ``file``, ``uri``, ``n_docs``, ``n_ids`` and ``ids_before``.  Document ids are whole numbers; a
    null id comes first.  Rows of one id go by a hash of the text and may span files, so a hot id is no more work for a task than others.
    A null or empty text has only the end id.  A file ends after the document with which its texts exceed ``file_bytes`` by half, or with its range.
    It is written under a name of its task attempt and then renamed, so repeated tasks do no harm.  Extra columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + ROW_BYTES)).first()[0] or 0
    ranges = min(MOST_RANGES, max(1, -(-total // file_bytes)))
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    bits, uri = bits_for(vocabulary), _uri(path)

    def write(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part = None, TaskContext.get().partitionId()
        writer, number, weight = None, 0, 0

        def opened():
            filesystem, folder = _open(uri)
            filesystem.create_dir(folder)
            temporary = f"{folder}/_{part:05d}-{number:05d}-{uuid.uuid4().hex}"
            return TokenWriter(filesystem.open_output_stream(temporary), bits), (filesystem, folder, temporary)

        def closed():
            writer[0].close()
            writer[0].out.close()
            filesystem, folder, temporary = writer[1]
            name = f"part-{part:05d}-{number:05d}.bin"
            filesystem.move(temporary, f"{folder}/{name}")
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "uri": [f"{uri}/{name}"],
                "n_docs": [len(writer[0].keys)], "n_ids": [writer[0].n],
            })

        for batch in batches:
            for rows in slices(batch, 1, ENCODED_BYTES):
                encoder = encoder or WordEncoder(shared.value, separable)
                if writer is None:
                    writer, weight = opened(), 0
                keys = [NO_KEY if k is None else k for k in rows.column(0).to_pylist()]
                if rows.num_rows == 1:
                    for piece in encoder.pieces(rows.column(1)):
                        writer[0].ids(encoder.flat(piece)[0])
                    writer[0].ids(np.array([end_id], np.uint32))
                    writer[0].end(keys, [writer[0].n])
                else:
                    before = writer[0].n
                    ids, ends = encoder.encode(rows.column(1), end_id)
                    writer[0].ids(ids)
                    writer[0].end(keys, (before + ends).tolist())
                weight += rows.column(1).nbytes + ROW_BYTES * rows.num_rows
                if 2 * weight > 3 * file_bytes:
                    yield closed()
                    writer, number = None, number + 1
        if writer is not None:
            yield closed()
        pa.default_memory_pool().release_unused()

    # the last key deals out rows that are equal in everything
    order = [F.col("id").asc_nulls_first(), F.col("hash").asc(), F.col("tie").asc()]
    rows = rows.withColumns({"hash": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
    ranged = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("id", "text")
    files = durable(ranged.mapInArrow(write, "part int, number int, uri string, n_docs long, n_ids long"))
    by = Window.orderBy("part", "number")  # one row a file
    before = F.sum("n_ids").over(by.rowsBetween(Window.unboundedPreceding, -1))
    return durable(files.select(
        (F.row_number().over(by) - 1).alias("file"), "uri", "n_docs", "n_ids", F.coalesce(before, F.lit(0)).alias("ids_before")
    ))


def read_token_files(files: DataFrame) -> DataFrame:
    """The documents of the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (little-endian 32-bit)."""

    def read(batches):
        for batch in batches:
            for uri, before in zip(*[batch.column(k).to_pylist() for k in range(2)], strict=True):
                filesystem, path = _open(uri)
                with filesystem.open_input_file(path) as source:
                    file = TokenFile(source)
                    starts = np.concatenate([[0], file.ends]).astype(np.int64)
                    k = 0
                    while k < file.n_docs:
                        top = int(np.searchsorted(starts, starts[k] + READ_IDS, "right")) - 1
                        top = min(max(top, k + 1), file.n_docs)
                        ids = file.ids(int(starts[k]), int(starts[top])).astype("<u4").view(np.uint8)
                        offsets = pa.py_buffer(((starts[k : top + 1] - starts[k]) * 4).astype(np.int64))
                        data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), top - k, [None, offsets, pa.py_buffer(ids)])
                        keys = pa.array(file.keys[k:top], mask=file.keys[k:top] == NO_KEY)
                        yield pa.RecordBatch.from_arrays(
                            [keys, pa.array(starts[k:top] + before), pa.array(np.diff(starts[k : top + 1])), data.cast(pa.binary())],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )
                        k = top

    # one row a file, written before: counted so that adaptive execution keeps one task a file
    return files.select("uri", "ids_before").repartition(max(1, files.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
