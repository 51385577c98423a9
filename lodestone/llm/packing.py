"""Packing of token sequences: multiway Karmarkar-Karp differencing of batches of documents.

A document's ids are cut into pieces of ``width``; whole ones are sequences by
themselves. The rests are gathered, some hundred windows' worth at a time, and
differenced: the two partial partitions of the largest imbalance are merged,
the largest part of one with the smallest of the other, until one partition
is left, whose parts are nearly equal. Where a part exceeds the width, the number
of windows rises. Documents stay whole unless a batch would then be padded by more than ``SPARE``: then
each eighth one, or fourth, and so on, is cut into its half, the half of the rest, ..., which even out the windows.

Batches are packed by the task that reads the documents. Only what is left at the end of
a task, less than a batch, is shuffled to others' rests.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel

from lodestone.llm.common import shared_folder

WIDTH = 2048
#: A batch holds so many windows' worth of ids, or so many pieces where these are small.
WINDOWS, PIECES = 128, 4096
SPARE = 0.01
#: No piece of so many ids is cut to save padding.
FINEST = 16
#: Bytes of words and their ids that a Python worker remembers, and characters of the longest such word.
CACHED_BYTES, CACHED_CHARS = 160 << 20, 40
#: Bytes of an entry beside its characters and ids.
ENTRY_BYTES = 220

#: What is known to be a letter, and characters that are known to be no letter, number or white space beside ASCII.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_SYMBOLS = "¡-©«-±´¶-¸»¿×÷‐-‧‰-⁞"
_ODD = re.compile(f"[^\\x00-\\x1b\\x20-\\x7f{_LETTERS}{_SYMBOLS}]")
#: The splitter of byte-level BPE over the characters above.
_PARTS = re.compile(f" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+")


class TextIds:
    """Little-endian 32-bit ids of whole texts, by the library alone."""

    def __init__(self, tokenizer: Tokenizer):
        self.encode = tokenizer.encode

    def text(self, text: str) -> bytes:
        return np.array(self.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class PartIds(dict):
    """Little-endian 32-bit ids of the parts of a text, for a byte-level BPE tokenizer.

    Its splitter lets no merge cross a part, so that a text's ids are those of its parts, and a part's are remembered.
    Texts with characters outside :data:`_ODD`'s known ones, or with a special token's spelling, go to the library as they are.
    """

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.whole = TextIds(tokenizer).text
        self.tokenize = tokenizer.model.tokenize
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        known = [*range(0x250), *range(0x2010, 0x205F)]
        self.spelt = {c: spell(chr(c))[0][0] for c in known}
        specials = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([_ODD.pattern, *specials]))
        self.early: dict[str, bytes] = {}
        self.held = self.early_held = 0

    def __missing__(self, part: str) -> bytes:
        ids = np.array([t.id for t in self.tokenize(part.translate(self.spelt))], "<u4").tobytes()
        if len(part) <= CACHED_CHARS:
            if self.held > CACHED_BYTES:
                if not self.early:  # frequent parts come early: half of the room is theirs for good
                    self.early = dict(islice(self.items(), len(self) // 2))
                    self.early_held = sum(ENTRY_BYTES + 2 * len(p) + len(i) for p, i in self.early.items())
                self.clear()
                self.update(self.early)
                self.held = self.early_held
            self.held += ENTRY_BYTES + 2 * len(part) + len(ids)
            self[part] = ids
        return ids

    def text(self, text: str) -> bytes:
        if self.odd.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, _PARTS.findall(text)))


def by_parts(tokenizer: Tokenizer) -> bool:
    """Whether the tokenizer is of the kind that :class:`PartIds` knows."""
    pre = json.loads(tokenizer.pre_tokenizer.__getstate__()) if tokenizer.pre_tokenizer else {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and tokenizer.normalizer is None
    model = tokenizer.model
    return bool(
        plain
        and isinstance(model, BPE)
        and not (model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix or model.ignore_merges)
        and not (tokenizer.truncation or tokenizer.padding)
        and not any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in tokenizer.get_added_tokens_decoder().values())
    )


@lru_cache(maxsize=1)
def text_ids(path: str) -> PartIds | TextIds:
    """One for a Python worker, which its later tasks find filled."""
    tokenizer = Tokenizer.from_file(path)
    return PartIds(tokenizer) if by_parts(tokenizer) else TextIds(tokenizer)


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The part, of ``k``, of each size: multiway Karmarkar-Karp.

    A partial partition is its parts' sums above the least, in falling order, and each
    part's first item; parts without an item aren't written out. Items of a part are a linked list.
    """
    n = len(sizes)
    link, tail = np.full(n, -1), np.arange(n)
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = n

    def padded(values, heads):
        room = k - len(values)
        return np.concatenate([values, np.zeros(room, np.int64)]), np.concatenate([heads, np.full(room, -1)])

    while len(heap) > 1:
        _, _, a, a_heads = heapq.heappop(heap)
        _, _, b, b_heads = heapq.heappop(heap)
        if len(a) + len(b) <= k:
            values, heads = np.concatenate([a, b]), np.concatenate([a_heads, b_heads])
        else:
            (a, a_heads), (b, b_heads) = padded(a, a_heads), padded(b, b_heads)
            b, b_heads = b[::-1], b_heads[::-1]
            values, heads = a + b, np.where(a_heads < 0, b_heads, a_heads)
            both = (a_heads >= 0) & (b_heads >= 0)
            link[tail[a_heads[both]]] = b_heads[both]
            tail[a_heads[both]] = tail[b_heads[both]]
        order = np.argsort(-values, kind="stable")
        values, heads = values[order], heads[order]
        if len(values) == k:
            values = values - values[-1]
        heapq.heappush(heap, (-int(values[0]), serial, values, heads))
        serial += 1
    out = np.zeros(n, np.int64)
    if heap:
        for part, item in enumerate(heap[0][3].tolist()):
            while item >= 0:
                out[item] = part
                item = link[item]
    return out


def cut(sizes: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, start and size of the pieces, where each ``every``-th item (0: none) is cut into its half, the half of the rest, and so on."""
    chosen = (np.arange(len(sizes)) % every == 0) & (sizes > FINEST) if every else np.zeros(len(sizes), bool)
    item, start, left = np.arange(len(sizes)), np.zeros(len(sizes), np.int64), sizes.astype(np.int64)
    items, starts, pieces = [item[~chosen]], [start[~chosen]], [left[~chosen]]
    item, start, left = item[chosen], start[chosen], left[chosen]
    while len(item):
        piece = np.where(left > FINEST, (left + 1) // 2, left)
        items.append(item)
        starts.append(start)
        pieces.append(piece)
        more = left > piece
        item, start, left = item[more], (start + piece)[more], (left - piece)[more]
    return np.concatenate(items), np.concatenate(starts), np.concatenate(pieces)


def windows_of(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Item, start, size and window of each piece, and the number of windows, none of which exceeds ``width``."""
    total = int(sizes.sum())
    least = -(-total // width)
    enough = least + int(SPARE * least)
    for every in (0, 8, 4, 2, 1):
        item, start, size = cut(sizes, every)
        k = least
        while every == 1 or k <= enough:
            window = difference(size, k)
            top = int(np.bincount(window, size, k).max())
            if top <= width:
                return item, start, size, window, k
            # The excess over the mean stays about the same with some more windows.
            k = max(k + 1, min(-(-total // max(1, width - int(top - total / k))), k + max(1, k // 64)))
    raise AssertionError("pieces of at most the width fit")


def _packed(rows: list[tuple], width: int) -> Iterator[tuple]:
    """Rows ``(doc_id, start, doc_tokens, ids)`` cut and laid into windows: ``(doc_id, start, ids, doc_tokens, window, offset)``."""
    item, start, size, window, k = windows_of(np.array([len(r[3]) // 4 for r in rows], np.int64), width)
    filled = [0] * k
    for i, at, n, w in zip(item.tolist(), start.tolist(), size.tolist(), window.tolist(), strict=True):
        doc_id, before, doc_tokens, ids = rows[i]
        yield doc_id, before + at, ids[4 * at : 4 * (at + n)], doc_tokens, w, filled[w]
        filled[w] += n


_COLUMNS = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _batch(rows: list[tuple], kind: pa.DataType, row_from: int) -> pa.RecordBatch:
    """Rows ``(doc_id, start, ids, doc_tokens, sequence_id, offset)``; ``row_from`` numbers them in their task."""
    doc_ids, start, ids, doc_tokens, sequence, offset = zip(*rows, strict=True)
    length = [len(x) // 4 for x in ids]
    longs = [pa.array(x, pa.int64()) for x in (start, length, doc_tokens, sequence, offset, range(row_from, row_from + len(rows)))]
    arrays = [pa.array(doc_ids, kind), longs[0], longs[1], pa.array(ids, pa.binary()), *longs[2:]]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "row"])


def _read_and_pack(docs: DataFrame, path: str, end_id: int, width: int, windows: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = text_ids(path)
        end = np.array([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 32
        made, row, held, rests, out, out_bytes = 0, 0, 0, [], [], 0
        column = None
        for batch in batches:
            column = batch.column(0).type
            # Some texts at a time: a batch of long ones isn't held twice.
            for at in range(batch.num_rows):
                ids = words.text(batch.column(1)[at].as_py() or "") + end
                doc_id, n = batch.column(0)[at].as_py(), len(ids) // 4
                for start in range(0, n, width):
                    piece = ids[4 * start : 4 * (start + width)]
                    if len(piece) == 4 * width:
                        out.append((doc_id, start, piece, n, first + made, 0))
                        out_bytes += len(piece)
                        made += 1
                    else:
                        rests.append((doc_id, start, n, piece))
                        held += len(piece) // 4
                if held >= windows * width or len(rests) >= PIECES:
                    packed = list(_packed(rests, width))
                    out += [(*p[:4], first + made + p[4], p[5]) for p in packed]
                    made += max(p[4] for p in packed) + 1
                    out_bytes, held, rests = out_bytes + 4 * held, 0, []
                if out_bytes > 8 << 20:
                    yield _batch(out, column, row)
                    row, out, out_bytes = row + len(out), [], 0
        out += [(r[0], r[1], r[3], r[2], None, None) for r in rests]
        if out:
            yield _batch(out, column, row)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, {_COLUMNS}, row long").withColumn("part", F.spark_partition_id())


def pack(docs: DataFrame, *, tokenizer: str, end_id: int = 1, width: int = WIDTH, windows: int = WINDOWS) -> DataFrame:
    """Pieces ``doc_id, start, length, ids, doc_tokens, sequence_id, offset`` of sequences of at most ``width`` ids.

    Every document has the ids of its whole text and ``end_id``; a null text or an empty one has ``end_id`` alone. ``ids`` are
    little-endian unsigned 32-bit. Each row is a document: equal rows and equal or null doc_ids are packed each by itself.
    Columns besides doc_id and text don't matter; no documents give no pieces. ``sequence_id`` is unique, not gapless.

    Pieces are written once to a new folder beside the checkpoints, where the result is read.
    """
    session = docs.sparkSession
    folder = f"{shared_folder(session)}/packed-{uuid.uuid4().hex}"
    _read_and_pack(docs, tokenizer, end_id, width, windows).write.option("compression", "zstd").parquet(folder)
    held = session.read.parquet(folder)
    rests = held.where("sequence_id IS NULL")
    n, total = rests.agg(F.count("*"), F.sum("length")).first()
    groups = max(1, -(-(total or 0) // (windows * width)), -(-n // PIECES))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("row", "ascending")])  # the same windows whenever it runs
        rows = list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True))
        first = ((1 << 30) + key[0].as_py()) << 32
        packed = [(*p[:4], first + p[4], p[5]) for p in _packed(rows, width)]
        return pa.Table.from_batches([_batch(packed, table.schema.field("doc_id").type, 0)])

    dealt = rests.withColumn("group", F.pmod(F.xxhash64("part", "row"), F.lit(groups)))
    dealt = dealt.groupBy("group").applyInArrow(run, f"doc_id {kind}, {_COLUMNS}, row long")
    columns = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return held.where("sequence_id IS NOT NULL").select(columns).unionByName(dealt.select(columns))


def digest(pieces: DataFrame) -> DataFrame:
    """``pieces`` with the checksum of their ids in place of these."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
