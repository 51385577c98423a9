"""Token ids in binary files: canonical length-limited Huffman codes.

A folder holds two Parquet tables. ``codebook`` (id, bits) gives the code
lengths, from which the canonical codes follow. ``blocks`` has a row for each
block of whole documents, in ascending doc_id order over its files:

- ``start``: ids of all documents before the block
- ``doc_ids``, ``counts``: its documents and how many ids each has
- ``lanes``: little-endian 16-bit lengths, in bits, of each run of ``LANE`` ids;
  their sums are the bit offsets at which decoding can start
- ``payload``: the codes, first bit highest

Decoding looks up ``MAX_BITS`` bits in a table, all lanes of a block abreast.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel

from lodestone.llm.common import settle, shared_folder, text_key

LANE = 64
MAX_BITS = 16
BLOCK_IDS = 1 << 16
#: Bytes of words and ids that a Python worker remembers, about so many beside the strings' own for each, and of the longest such word.
CACHED_BYTES, ENTRY_BYTES, LONGEST = 160 << 20, 200, 64


#: Latin letters in composed form whose lower case is one letter, then ASCII punctuation.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]+)([!-/:-@\\[-`{-~]*)")


#: The normaliser and splitter for which a text's ids are those of its words.
_NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def by_words(tokenizer: Tokenizer) -> bool:
    """Whether the tokenizer is of the kind that :class:`WordIds` knows; its special tokens hold no white space."""
    state = lambda part: json.loads(part.__getstate__()) if part else None
    known = state(tokenizer.normalizer) == _NORMALISER and state(tokenizer.pre_tokenizer) == {"type": "Sequence", "pretokenizers": [_SPLITTER, _BYTES]}
    plain = isinstance(tokenizer.model, BPE) and not tokenizer.model.dropout and not tokenizer.truncation and not tokenizer.padding
    added = tokenizer.get_added_tokens_decoder().values()
    return known and plain and not any(t.normalized or t.lstrip or t.rstrip or t.single_word or t.content.split() != [t.content] for t in added)


class TextIds:
    """Little-endian 16-bit ids of whole texts, by the library alone."""

    def __init__(self, tokenizer: Tokenizer):
        self.encode = tokenizer.encode

    def text(self, text: bytes) -> bytes:
        return array("H", self.encode(text.decode("utf-8"), add_special_tokens=False).ids).tobytes()


class WordIds(dict):
    """Little-endian 16-bit ids of a word; words are split at ASCII white space.

    This tokenizer's normaliser and splitter drop white space and nothing they
    do looks across it, so that a text's ids are those of its words. A plain
    word is letters and then punctuation, which the splitter parts; its
    lower-case letters go to the library's BPE model alone, which costs less
    than a call for the whole word.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.encode, self.model = tokenizer.encode, tokenizer.model
        self.bytes_of = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.shown: dict[str, str] = {}
        self.early: dict[bytes, bytes] = {}
        self.held = self.early_held = 0

    def keep(self, word: bytes, ids: bytes) -> None:
        """Remember a word. When all take too much, the later half is forgotten: frequent words come early."""
        if len(word) > LONGEST or word in self:
            return
        if self.held > CACHED_BYTES:
            if not self.early:
                self.early = dict(islice(self.items(), len(self) // 2))
                self.early_held = sum(ENTRY_BYTES + len(w) + len(i) for w, i in self.early.items())
            self.clear()
            self.update(self.early)
            self.held = self.early_held
        self.held += ENTRY_BYTES + len(word) + len(ids)
        self[word] = ids

    def letters(self, word: bytes) -> bytes:
        if (ids := self.get(word)) is None:
            spelt = word.decode("utf-8")
            if not word.isascii():
                for c in spelt:
                    if c not in self.shown:
                        self.shown[c] = self.bytes_of(c)[0][0]
                spelt = "".join(map(self.shown.__getitem__, spelt))
            ids = array("H", [t.id for t in self.model.tokenize(spelt)]).tobytes()
            self.keep(word, ids)
        return ids

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters
            ids = self.letters(word.lower())
        elif word[:-1].isalpha() and word[-1:] in b".,":
            ids = self.letters(word[:-1].lower()) + self.letters(word[-1:])
        elif m := _PLAIN.fullmatch(text := word.decode("utf-8")):
            ids = self.letters(m[1].lower().encode("utf-8"))
            if m[2]:
                ids += self.letters(m[2].encode("utf-8"))
        else:
            ids = array("H", self.encode(text, add_special_tokens=False).ids).tobytes()
        self.keep(word, ids)
        return ids

    def text(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds | TextIds:
    """One for a Python worker, which its later tasks find filled; whole texts where words aren't known to do."""
    tokenizer = Tokenizer.from_file(path)
    if tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError("ids don't fit into 16 bits")
    return WordIds(tokenizer) if by_words(tokenizer) else TextIds(tokenizer)


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Lengths of a cheapest prefix code with none longer than ``most`` bits (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << most:
        raise ValueError("too many symbols for the code length")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    level, flags = leaves, []
    flags.append(np.ones(n, bool))
    for _ in range(most - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        place = np.argsort(both, kind="stable")
        level = both[place]
        flags.append(place < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(flags):
        own = int(leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Canonical codes: by length, then id."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        ids, bits = ids[order], bits[order].astype(np.int64)
        width = 1 << (MAX_BITS - bits)
        first = np.concatenate(([0], np.cumsum(width)[:-1]))
        size = int(ids.max()) + 1 if len(ids) else 1
        self.code, self.bits = np.zeros(size, np.uint32), np.zeros(size, np.uint8)
        self.code[ids] = first >> (MAX_BITS - bits)
        self.bits[ids] = bits
        self.symbol = np.zeros(1 << MAX_BITS, np.uint32)
        self.length = np.zeros(1 << MAX_BITS, np.uint8)
        filled = int(width.sum())
        self.symbol[:filled] = np.repeat(ids, width)
        self.length[:filled] = np.repeat(bits, width)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Payload and lanes."""
        if not len(ids):
            return b"", b""
        bits = self.bits[ids].astype(np.int64)
        ends = np.cumsum(bits)
        at = ends - bits
        value = self.code[ids].astype(np.int64) << (24 - bits - (at & 7))
        byte, size = at >> 3, (int(ends[-1]) >> 3) + 3
        out = np.zeros(size, np.int64)
        for k in range(3):
            part = np.bincount(byte + k, (value >> (16 - 8 * k)) & 255, size)
            out += part[:size].astype(np.int64)
        lanes = np.add.reduceat(bits, np.arange(0, len(ids), LANE)).astype("<u2")
        return out[: (int(ends[-1]) + 7) >> 3].astype(np.uint8).tobytes(), lanes.tobytes()

    def decode(self, payload: bytes, lanes: bytes, n: int) -> np.ndarray:
        if not n:
            return np.empty(0, np.uint32)
        raw = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
        three = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
        length = np.frombuffer(lanes, "<u2").astype(np.int64)
        at = np.cumsum(length) - length
        out = np.zeros((LANE, len(at)), np.uint32)
        last = n - LANE * (len(at) - 1)
        for k in range(LANE):
            if k == last:
                at = at[:-1]
            window = (three[at >> 3] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF
            out[k, : len(at)] = self.symbol[window]
            at = at + self.length[window]
        return out.T.reshape(-1)[:n]


def _tokenise(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Blocks of whole documents in doc_id order, with 16-bit ids in zstandard frames."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = word_ids(path)
        end = np.array([end_id], "<u2").tobytes()
        packer = zstandard.ZstdCompressor(level=1)
        part, before, number, held = TaskContext.get().partitionId(), 0, 0, 0
        keys, counts, ids = [], [], []

        def block():
            joined = b"".join(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([number], pa.int32()),
                    pa.array([before], pa.int64()),
                    pa.array([keys]).cast(pa.list_(batch_kind)),
                    pa.array([counts], pa.list_(pa.int64())),
                    pa.array([packer.compress(joined)], pa.binary()),
                ],
                ["part", "number", "before", "doc_ids", "counts", "ids"],
            )

        for batch in batches:
            batch_kind = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = words.text(text or b"") + end
                keys.append(key)
                counts.append(len(own) // 2)
                ids.append(own)
                held += counts[-1]
                if held >= BLOCK_IDS:
                    yield block()
                    before, number, held = before + held, number + 1, 0
                    keys, counts, ids = [], [], []
        if keys:
            yield block()

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), text_key(F.col("text")).alias("key"))
    # Equal doc_ids are split by their texts.
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "key").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "key")
    return rows.drop("key").mapInArrow(run, f"part int, number int, before long, doc_ids array<{kind}>, counts array<long>, ids binary")


def _unpacked(frame: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(frame), "<u2")


def write_tokens(docs: DataFrame, folder: str, *, tokenizer: str, end_id: int = 2) -> None:
    """Encode every whole text and write the files to ``folder``.

    Each document's ids are followed by ``end_id``; a null text has no others.
    Documents stand in ascending doc_id order (null first), repeated doc_ids by a
    hash of their text, equal rows as often as they come. The tokenizer must
    have at most 65,536 ids; one of another kind than :func:`by_words` knows
    encodes whole texts. No documents give empty tables.
    """
    session = docs.sparkSession
    staged = settle(_tokenise(docs, tokenizer, end_id))

    def count(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for frame in batch.column(0).to_pylist():
                total += np.bincount(_unpacked(frame), minlength=1 << 16)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    counted = staged.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = sorted((r["id"], r["n"]) for r in counted.collect())  # at most 65,536 ids
    ids = np.array([c[0] for c in counts], np.int64)
    bits = code_lengths(np.array([c[1] for c in counts], np.int64))
    session.createDataFrame([(int(i), int(b)) for i, b in zip(ids, bits, strict=True)], "id long, bits int").coalesce(1).write.parquet(f"{folder}/codebook")
    sizes = staged.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)).alias("n"))
    offset, starts = 0, {}
    for r in sorted(sizes.collect(), key=lambda r: r["part"]):  # a row for each partition
        starts[r["part"]] = offset
        offset += r["n"]
    sent = session.sparkContext.broadcast((Codebook(ids, bits), starts))

    def encode(batches):
        book, starts = sent.value
        for batch in batches:
            part, _, before, _, _, frames = (batch.column(i).to_pylist() if i not in (3, 4) else None for i in range(6))
            packed = [book.encode(_unpacked(f)) for f in frames]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([starts[p] + b for p, b in zip(part, before, strict=True)], pa.int64()),
                    batch.column(3),
                    batch.column(4),
                    pa.array([p[1] for p in packed], pa.binary()),
                    pa.array([p[0] for p in packed], pa.binary()),
                ],
                ["start", "doc_ids", "counts", "lanes", "payload"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    staged.mapInArrow(encode, f"start long, doc_ids array<{kind}>, counts array<long>, lanes binary, payload binary").write.option("compression", "none").parquet(f"{folder}/blocks")


def read_tokens(session: SparkSession, folder: str, *, digest: bool = False) -> DataFrame:
    """Each document's ``doc_id, start, n_tokens`` and its ``ids``, or, as a digest, their ``ids_crc32``."""
    blocks = session.read.parquet(f"{folder}/blocks")
    book = session.read.parquet(f"{folder}/codebook").collect()  # at most 65,536 rows
    sent = session.sparkContext.broadcast(Codebook(np.array([r["id"] for r in book], np.int64), np.array([r["bits"] for r in book], np.int64)))

    def decode(batches):
        book = sent.value
        for batch in batches:
            starts, keys, counts, lanes, payload = (batch.column(i).to_pylist() for i in range(5))
            for row in range(batch.num_rows):
                n = np.array(counts[row], np.int64)
                ends = np.cumsum(n)
                ids = book.decode(payload[row], lanes[row], int(ends[-1])).astype("<u4")
                pieces = np.split(ids, ends[:-1])
                value = pa.array([zlib.crc32(p.tobytes()) for p in pieces], pa.int64()) if digest else pa.array([p.tolist() for p in pieces], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[row]).cast(batch.schema.field(1).type.value_type),
                        pa.array(starts[row] + ends - n, pa.int64()),
                        pa.array(n),
                        value,
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    last = "ids_crc32 long" if digest else "ids array<int>"
    return blocks.select("start", "doc_ids", "counts", "lanes", "payload").mapInArrow(decode, f"doc_id {kind}, start long, n_tokens long, {last}")


def round_trip(docs: DataFrame, *, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write to a new folder beside the checkpoints and read it back as digests."""
    session = docs.sparkSession
    folder = f"{shared_folder(session)}/token-ids-{uuid.uuid4().hex}"
    write_tokens(docs, folder, tokenizer=tokenizer, end_id=end_id)
    return read_tokens(session, folder, digest=True)
