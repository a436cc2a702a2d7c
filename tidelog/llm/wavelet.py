"""Token ids in wavelet matrices, one compressed file per shard.

A shard holds the ids of whole documents in order. Its distinct ids are numbered by falling frequency,
so the upper bit-planes are nearly all zeros and compress well. Each plane keeps the count of ones
before every 512 bits; with them `access`, `count` and `find` (select) work on the planes alone, and
`ids` reads a whole shard back plane by plane. A plane's bits are packed in chunks, and a lookup reads
from the file only the chunks that it meets: one a plane for a token, two for a count in a range.

`write` makes the files and a table of them, `documents`, `at_places`, `occurrences` and `found_at` ask them.

Layout, all numbers little-endian: the magic WMX2, the length of a JSON header (4 bytes), the header,
then the sections that the header lists with their places, each a zstd frame: `alphabet` (4 bytes an
id), `doc_ids` (8 bytes), `known` (1 byte, 0 for a null doc id), `lengths` (8 bytes), for each plane its counts
(4 bytes) and its bits in chunks of 65,536 (bit k of byte j is place 8 j + k), the last one shorter.
"""

from __future__ import annotations

import json
import os
import re
import string
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import scratch, written

MAGIC = b"WMX2"
BLOCK = 512  # bits between counts
CHUNK = 1 << 16  # bits of a plane that are packed together
SHARD = 1 << 20  # a shard closes once it has so many ids
PIECE = 8 << 20  # bytes of texts that are encoded at once, or one text
WORDS = 400_000  # words whose ids a worker keeps, twice: the latest and those before
SPAN = 1 << 16  # places that one lookup task gathers at most from a shard
TASK_BYTES = 64 << 20  # bytes of files that a task reads in the mean
SHARDS = "part int, seq int, before long, n_tokens long, n_docs long, n_bytes long, file string"


def _places(side: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Where each SHARD of a mask starts, and the places in it that are set: twice as fast as the mask, and bounded."""
    for k in range(0, len(side), SHARD):
        yield k, np.flatnonzero(side[k : k + SHARD])


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """A shard's file image. ids: of all its documents, one after another; lengths: ids of each."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    n = len(ids)
    counts = np.bincount(ids) if n else np.zeros(0, np.int64)
    alphabet = np.flatnonzero(counts)
    alphabet = alphabet[np.argsort(-counts[alphabet], kind="stable")]
    code = np.zeros(len(counts), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    code[alphabet] = np.arange(len(alphabet))
    s = code[ids]
    levels = max(len(alphabet) - 1, 0).bit_length()
    sections: list[tuple[str, bytes]] = [("alphabet", alphabet.astype("<u4").tobytes()), ("doc_ids", np.array([d or 0 for d in doc_ids], "<i8").tobytes()), ("known", np.array([d is not None for d in doc_ids], np.uint8).tobytes()), ("lengths", np.array(lengths, "<i8").tobytes())]
    zeros = []
    for level in range(levels):
        bit = (s >> (levels - 1 - level)) & 1 != 0
        bits = np.packbits(bit, bitorder="little")
        full = np.zeros(-(-n // BLOCK) * BLOCK // 8, np.uint8)
        full[: len(bits)] = bits
        ones = np.bitwise_count(full.view("<u8")).reshape(-1, BLOCK // 64).sum(1, dtype=np.int64)
        sections.append((f"ones{level}", (np.cumsum(ones) - ones).astype("<u4").tobytes()))
        sections += [(f"bits{level}.{k}", bits[k * CHUNK // 8 : (k + 1) * CHUNK // 8].tobytes()) for k in range(-(-n // CHUNK))]
        zeros.append(n - int(ones.sum()))
        s = np.concatenate([s[k : k + SHARD][at] for side in (~bit, bit) for k, at in _places(side)])
    packed = [(name, pack(x)) for name, x in sections]
    places, at = {}, 0
    for name, x in packed:
        places[name] = [at, len(x)]
        at += len(x)
    head = json.dumps({"n": n, "docs": len(doc_ids), "levels": levels, "zeros": zeros, "sections": places}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *(x for _, x in packed)])


class Wavelet:
    """A shard of a file image, or of a function (offset, length) -> bytes that reads a file. Sections are read and unpacked when first needed; `reads` counts them."""

    def __init__(self, source: bytes | Callable[[int, int], bytes]):
        self.read = source if callable(source) else lambda at, n: source[at : at + n]
        start = self.read(0, 8)
        if start[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        size = int.from_bytes(start[4:8], "little")
        self.head = json.loads(self.read(8, size))
        self.base, self.reads = 8 + size, 0
        self.n, self.levels, self.zeros = self.head["n"], self.head["levels"], self.head["zeros"]
        self.kept: dict[str, np.ndarray] = {}

    def _unpack(self, name: str) -> bytes:
        import zstandard

        at, size = self.head["sections"][name]
        self.reads += 1
        return zstandard.ZstdDecompressor().decompress(self.read(self.base + at, size))

    def section(self, name: str, kind: str) -> np.ndarray:
        if name not in self.kept:
            self.kept[name] = np.frombuffer(self._unpack(name), kind)
        return self.kept[name]

    @property
    def alphabet(self) -> np.ndarray:
        return self.section("alphabet", "<u4")

    def docs(self) -> Iterator[tuple[int | None, int, int]]:
        """doc_id, start in the shard and number of ids of each document."""
        at = 0
        for d, k, n in zip(self.section("doc_ids", "<i8").tolist(), self.section("known", np.uint8).tolist(), self.section("lengths", "<i8").tolist(), strict=True):
            yield d if k else None, at, n
            at += n

    def _words(self, level: int, places: np.ndarray | None = None) -> np.ndarray:
        """A plane's bits as 8-byte words, a row each BLOCK; read are the chunks that hold the places, or all."""
        if f"words{level}" not in self.kept:
            self.kept[f"words{level}"] = np.zeros(((-(-self.n // BLOCK) + 1) * BLOCK // 64), "<u8")
            self.kept[f"have{level}"] = np.zeros(-(-self.n // CHUNK), bool)
        words, have = self.kept[f"words{level}"], self.kept[f"have{level}"]
        want = range(len(have)) if places is None else np.unique(np.asarray(places) // CHUNK).tolist()
        for k in want:
            if k < len(have) and not have[k]:
                raw = np.frombuffer(self._unpack(f"bits{level}.{k}"), np.uint8)
                words.view(np.uint8)[k * CHUNK // 8 : k * CHUNK // 8 + len(raw)] = raw
                have[k] = True
        return words.reshape(-1, BLOCK // 64)

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each place."""
        at = np.asarray(at, np.int64)
        words, before = self._words(level, at), self.section(f"ones{level}", "<u4")
        blocks = at // BLOCK
        total = np.where(blocks < len(before), before[np.minimum(blocks, len(before) - 1)] if len(before) else 0, self.n - self.zeros[level])
        inside = at % BLOCK
        k = np.arange(BLOCK // 64)
        width = np.clip(inside[:, None] - 64 * k, 0, 64).astype(np.uint64)
        mask = np.where(width == 64, ~np.uint64(0), (np.uint64(1) << (width & np.uint64(63))) - np.uint64(1))
        return total.astype(np.int64) + np.bitwise_count(words[blocks] & mask).sum(1, dtype=np.int64)

    def access(self, places: np.ndarray) -> np.ndarray:
        """The ids at the places."""
        at = np.asarray(places, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("place outside the shard")
        code = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            w = self._words(level, at).reshape(-1)
            bit = ((w[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            ones = self._ones(level, at)
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
            code = code << 1 | bit
        return self.alphabet[code] if len(code) else self.alphabet[:0]

    def _code(self, token: int) -> int:
        found = np.flatnonzero(self.alphabet == token)
        return int(found[0]) if len(found) else -1

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of token in places start..end-1."""
        code, a, b = self._code(token), max(start, 0), min(self.n if end is None else end, self.n)
        if code < 0 or a >= b:
            return 0
        for level in range(self.levels):
            x, y = self._ones(level, np.array([a, b]))
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if code >> (self.levels - 1 - level) & 1 else (a - x, b - y)
        return int(b - a)

    def find(self, token: int, k: int = 0) -> int:
        """The place of occurrence number k (from 0) of token, or -1."""
        return int(self.places(token, np.array([k]))[0]) if 0 <= k < self.count(token) else -1

    def places(self, token: int, ks: np.ndarray) -> np.ndarray:
        """The places of the occurrences of those numbers, all of which must exist."""
        code, a = self._code(token), 0
        for level in range(self.levels):
            x = int(self._ones(level, np.array([a]))[0])
            a = self.zeros[level] + x if code >> (self.levels - 1 - level) & 1 else a - x
        at = a + np.asarray(ks, np.int64)
        for level in reversed(range(self.levels)):
            one = code >> (self.levels - 1 - level) & 1
            at = self._select(level, one, at - self.zeros[level] if one else at)
        return at

    def _select(self, level: int, one: int, k: np.ndarray) -> np.ndarray:
        """The places of ones (or zeros) number k of a plane: a search among the counts, then in one block each."""
        before = self.section(f"ones{level}", "<u4").astype(np.int64)
        if not one:
            before = np.arange(len(before)) * BLOCK - before
        block = np.searchsorted(before, k, "right") - 1
        bits = np.unpackbits(self._words(level, block * BLOCK)[block].view(np.uint8), axis=1, bitorder="little") == one
        return block * BLOCK + (np.cumsum(bits, axis=1) == (k - before[block] + 1)[:, None]).argmax(1)

    def ids(self) -> np.ndarray:
        """All ids of the shard, from the lowest plane up."""
        s = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in reversed(range(self.levels)):
            bit = np.unpackbits(self._words(level).reshape(-1).view(np.uint8), count=self.n, bitorder="little").view(bool)
            up = np.empty_like(s)
            z = self.zeros[level]
            for side, part in ((~bit, s[:z]), (bit, s[z:] | s.dtype.type(1 << (self.levels - 1 - level)))):
                done = 0
                for k, at in _places(side):
                    up[k : k + SHARD][at] = part[done : done + len(at)]
                    done += len(at)
            s = up
        return self.alphabet[s]


class WordIds:
    """Ids of whole texts by a tokenizer that ignores case and never joins across spaces, tabs and line feeds.

    Texts are cut at those, and where ASCII letters, digits and marks meet, as the tokenizer's own pattern
    does (an apostrophe may belong to the letters after it, so nothing is cut there). What is between repeats:
    the library encodes each once, and a text is joined from what it gave. ASCII letters that no other character
    may change are put in lower case first. A word of letters with closing marks is encoded as its letters and its
    marks (not where normalizing or lower case makes a mark of a letter's part, which may join the marks after
    it); such letters go to the library many at a time, each word ending with the one token that has the end-of-word
    suffix, and Latin-1 ones in lower case without its normalizer and pattern, which leave them as they are. Where
    `<|` may begin a special token, texts are cut at white space only. All this holds for a tokenizer that drops white
    space, as the README of the vocabulary files says of word_bpe_49k; the tests hold it against the library on whole texts.
    """

    MARKS = string.punctuation.replace("'", "")  # an apostrophe may belong to the letters after it
    PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch  # letters in lower case that no step before the merges changes
    GAP = re.compile(rb"[ \n\t]").search
    #: Tables for bytes.translate: a byte's kind (1 letter, 2 digit, 3 mark, 4 white space, 0 other), and for kinds a and b at 8 a + b whether to cut between them.
    KINDS = bytes(1 if chr(c) in string.ascii_letters else 2 if chr(c) in string.digits else 3 if chr(c) in string.punctuation and c != 39 else 4 if c in b" \n\t" else 0 for c in range(256))
    BLANK = bytes(32 if c in b"\n\t" else c for c in range(256))
    CUTS = bytes(a % 8 == 4 or (0 < a >> 3 < 4 and 0 < a % 8 < 4 and (a >> 3 != a % 8 or a == 8 * 2 + 2)) for a in range(256))

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        self.closes = np.zeros(t.get_vocab_size(), bool)
        for piece, i in t.get_vocab().items():
            self.closes[i] = piece.endswith("</w>")
        plain = json.loads(t.to_str()) | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
        self.letters = Tokenizer.from_str(json.dumps(plain))
        self.kept: list[dict[str, bytes]] = [{}, {}]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Little-endian 4-byte ids of each text."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if not len(texts):
            return []
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = bytes(memoryview(texts.buffers()[2] or b"")[bounds[0] : bounds[-1]])
        if len(texts) == 1 and (gap := self.GAP(raw, PIECE)):
            return [b"".join(self._long(raw, gap.start()))]
        bounds = bounds - bounds[0]
        kinds = np.frombuffer(raw.translate(self.KINDS), np.uint8)
        starts = kinds == 4
        data = np.frombuffer(raw.translate(self.BLANK), np.uint8)
        if b"<|" not in raw:
            upper = data - np.uint8(65) < 26
            upper[:-1] &= data[1:] < 128  # else normalizing may join it with what follows
            data = data + (upper.view(np.uint8) << 5)
            starts[1:] = np.frombuffer((kinds[:-1] << 3 | kinds[1:]).tobytes().translate(self.CUTS), bool)
        starts[bounds[:-1][bounds[:-1] < len(data)]] = True
        at = np.flatnonzero(starts)
        words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)).dictionary_encode()
        found = self._ids([w.lstrip(" ") for w in words.dictionary.to_numpy(zero_copy_only=False).tolist()])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(np.append(0, np.cumsum(sizes))), pa.py_buffer(b"".join(found))])
        joined = each.take(words.indices)
        ends = np.frombuffer(joined.buffers()[1], np.int64)[np.searchsorted(at, bounds)].tolist() if len(at) else [0] * len(bounds)
        ids = memoryview(joined.buffers()[2] or b"")
        return [bytes(ids[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)]

    def _long(self, raw: bytes, end: int) -> Iterator[bytes]:
        """Ids of the parts of a text that is longer than a piece, cut at white space; end: of the first part."""
        start = 0
        while start < len(raw):
            yield self.encode([raw[start:end].decode()])[0]
            gap = self.GAP(raw, end + PIECE)
            start, end = end, gap.start() if gap else len(raw)

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word; kept[0] starts anew when full, and what kept[1] has moves to it."""
        if len(self.kept[0]) > WORDS:
            self.kept[:] = [{}, self.kept[0]]
        known = self.kept[0]
        found = list(map(known.get, words))
        new, halves, other = self._missing({w for w, x in zip(words, found, strict=True) if x is None}), {}, []
        for w in new:
            stem = w.rstrip(self.MARKS)
            if stem.isalpha() and (stem.isascii() or unicodedata.normalize("NFC", stem).lower().isalpha()):
                halves[w] = (low if self.PLAIN(low := stem.lower()) else stem, w[len(stem) :])
            else:
                other.append(w)
        whole = {*other, *self._missing({m for _, m in halves.values()})}
        for w, e in zip(x := list(whole), self.tokenizer.encode_batch_fast(x, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()
        stems = self._missing({s for s, _ in halves.values()})
        self._encode([s for s in stems if self.PLAIN(s)], self.letters)
        self._encode([s for s in stems if not self.PLAIN(s)], self.tokenizer)
        for w, (stem, m) in halves.items():
            if w != stem:
                known[w] = known[stem] + known[m]
        return [known[w] if x is None else x for w, x in zip(words, found, strict=True)]

    def _missing(self, wanted: set[str]) -> set[str]:
        """What of wanted is not kept, after moving to kept[0] what kept[1] has."""
        known, old = self.kept
        rest = wanted.difference(known)
        for w in rest:
            if w in old:
                known[w] = old[w]
        return rest.difference(old)

    def _encode(self, stems: list[str], tokenizer) -> None:
        """Adds words of letters alone to kept[0]."""
        known = self.kept[0]
        for k in range(0, len(stems), 1000):
            part = stems[k : k + 1000]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = 4 * (np.flatnonzero(self.closes[ids]) + 1)
            raw = ids.tobytes()
            if len(ends) != len(part):  # some word is more than one token word after all
                for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    known[w] = np.array(e.ids, "<u4").tobytes()
                continue
            for w, a, z in zip(part, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                known[w] = raw[a:z]


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch (doc_id, text) of at most PIECE bytes of text, or of one row."""
    ends = np.append(0, np.cumsum(pc.binary_length(batch.column(1)).to_numpy(), dtype=np.int64))
    k = 0
    while k < batch.num_rows:
        n = max(int(np.searchsorted(ends, ends[k] + PIECE, "right")) - 1 - k, 1)
        yield batch.slice(k, n)
        k += n


def write(docs: DataFrame, tokenizer: str, end: int = 2, shard: int = SHARD, at: str | None = None) -> DataFrame:
    """Encode docs (doc_id, text), append `end` to each, and write shards in ascending doc_id order.

    Returns the table of shards (part, seq, before, n_tokens, n_docs, n_bytes, file) where it was written:
    `before` counts the ids of earlier shards of its part, parts and seqs ascend with doc_id. A task names
    its files after its attempt, and the table holds only what committed tasks report: a task that runs
    twice leaves files that no row points to, never a wrong row. Null ids come first; rows with equal ids stay, ordered by text; null text is
    empty and gives `end` alone; a document is never split, so one longer than a shard fills its own.
    The shuffle carries texts, not ids, and is ranged, so no id or source makes one task large.
    """
    at = at or scratch(docs.sparkSession, "tokens")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    tail = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(at)
        files.create_dir(root, recursive=True)
        encode, task = word_ids(tokenizer).encode, TaskContext.get()
        part, seq, before = task.partitionId(), 0, 0
        held: list[bytes] = []
        doc_ids: list[int | None] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, before, held, doc_ids, size
            lengths = [len(x) // 4 for x in held]
            n = sum(lengths)
            data = build(np.frombuffer(b"".join(held), "<u4"), doc_ids, lengths)
            name = f"{part:06d}-{task.taskAttemptId()}-{seq:05d}.wmx"
            with files.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(data)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before]), pa.array([n]), pa.array([len(held)]), pa.array([len(data)]), pa.array([f"{at}/{name}"])], ["part", "seq", "before", "n_tokens", "n_docs", "n_bytes", "file"])
            seq, before, held, doc_ids, size = seq + 1, before + n, [], [], 0
            return row

        for b in batches:
            for piece in pieces(b):
                for d, x in zip(piece.column(0).to_pylist(), encode(piece.column(1)), strict=True):
                    held.append(x + tail)
                    doc_ids.append(d)
                    size += len(x) // 4 + 1
                    if size >= shard:
                        yield close()
        if held:
            yield close()

    return written(d.mapInArrow(run, SHARDS), "token-shards")


def opened(file: str) -> Wavelet:
    """The shard in a file, of which only what is asked for is read."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(file)
    f = files.open_input_file(path)
    return Wavelet(lambda at, n: f.read_at(n, at))


def placed(shards: DataFrame) -> DataFrame:
    """shards with `first`: the ids of all shards before. One row a part is summed in order."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.select("part", (F.sum("n").over(order) - F.col("n")).alias("_ahead"))
    return shards.join(parts, "part").withColumn("first", F.col("before") + F.col("_ahead")).drop("_ahead")


def _dealt(shards: DataFrame) -> DataFrame:
    """Shards in tasks by their bytes: TASK_BYTES each in the mean, and as many as run at once, at least."""
    total = shards.agg(F.sum("n_bytes")).first()[0] or 0
    return shards.repartition(int(max(-(-total // TASK_BYTES), shards.sparkSession.sparkContext.defaultParallelism)))


def documents(shards: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and the CRC-32 of its ids as unsigned 32-bit little-endian integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = opened(file)
                raw = memoryview(w.ids().astype("<u4").tobytes())
                rows = [(d, first + at, n, zlib.crc32(raw[4 * at : 4 * (at + n)])) for d, at, n in w.docs()]
                ids, starts, ns, crcs = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ns, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _dealt(placed(shards)).select("first", "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def at_places(shards: DataFrame, places: DataFrame) -> DataFrame:
    """place and token of each place (a number from 0 over all shards) of places; places outside and null ones give none.

    Places meet shards by range: a shard's places are gathered as one list for each SPAN of ids, which bounds it.
    """
    d = placed(shards)
    spans = d.withColumn("_span", F.explode(F.sequence(F.expr(f"first div {SPAN}"), F.expr(f"(first + greatest(n_tokens, 1) - 1) div {SPAN}"))))
    asked = places.select(F.col("place").cast("long").alias("place")).distinct().withColumn("_span", F.expr(f"place div {SPAN}"))
    met = asked.join(spans, "_span").where("place >= first AND place < first + n_tokens").groupBy("file", "first", "_span").agg(F.collect_list("place").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, first, at in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(opened(file).access(np.array(at) - first).astype(np.int64))], ["place", "token"])

    return met.select("file", "first", "places").mapInArrow(run, "place long, token long")


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """part, seq and n: how often each shard holds a token, by rank on its planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([opened(f).count(token) for f in b.column(2).to_pylist()], pa.int64())], ["part", "seq", "n"])

    return _dealt(shards).select("part", "seq", "file").mapInArrow(run, "part int, seq int, n long")


def found_at(shards: DataFrame, token: int) -> DataFrame:
    """place of every occurrence of a token over all shards, by select on their planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = opened(file)
                for a in range(0, n := w.count(token), 1 << 14):
                    yield pa.RecordBatch.from_arrays([pa.array(first + w.places(token, np.arange(a, min(a + (1 << 14), n))), pa.int64())], ["place"])

    return _dealt(placed(shards)).select("first", "file").mapInArrow(run, "place long")
