"""Suffix-array dedup by blockwise construction over difference covers.

Two equal strings of ``length`` bytes have, at one of the first ``period``
offsets, positions that both belong to the difference cover; the
``length - period + 1`` bytes from there are equal too. So keys of cover positions are
compared first: only suffixes beside a key held twice can tie with another
over ``length`` bytes.

These are dealt into buckets by the least gram that their ``length`` bytes hold, so that ties
meet. Neighbouring suffixes of one bucket travel as one segment of text. Buckets
are sorted one at a time, each over its own text alone: suffixes that tie by a hash are
compared by their first bytes and then by the ranks of positions of a small
difference cover of that text, which are made beforehand and exact. All but the
earliest of each tie are covered.

A passage that many documents share in different surroundings has one gram that is the least
of most suffixes around it. A bucket that has grown too heavy so is split: its suffixes
are dealt by 128-bit keys of their bytes, which spread whatever grams they share.

Documents in order are cut into chunks; a segment that a chunk repeats, and
in a bucket one that several chunks hold, is sorted once. Back come bit masks.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import settle, shared_folder, text_key

#: A perfect difference set: every residue is a difference of two members.
PERIOD, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
LENGTH = 100
#: Bytes of the grams of which the least one decides a suffix's bucket.
GRAM = 16
#: The cover of a bucket's text, and for two residues the offset at which both meet it.
STEP, SMALL = 7, (0, 1, 3)
_MEET = np.array([[next(d for d in range(STEP) if (a + d) % STEP in SMALL and (b + d) % STEP in SMALL) for b in range(STEP)] for a in range(STEP)])
#: Keys that a bucket holds at most on average, the fewer the smaller the corpus.
BUCKET_KEYS = (1 << 19, 1 << 20, 1 << 21)
#: Bytes of a chunk; as many as give a bucket ``ROW_KEYS`` keys from each chunk, within these bounds.
CHUNK_BYTES, ROW_KEYS = (1 << 20, 1 << 24), 16
#: Bytes of segments from which on a bucket is split, or so many times the mean bucket's where that is more.
HEAVY, HEAVY_MEANS = 4 << 20, 4
#: Keys that a range of split buckets' suffixes holds on average.
RANGE_KEYS = 1 << 19
_A, _B, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(32)


def layout(total: int) -> tuple[int, int]:
    """Bytes of a chunk, and the base-two logarithm of the number of buckets, for this many bytes of text."""
    n_ranks = total * len(COVER) // PERIOD + 1
    for most in BUCKET_KEYS:
        log = max(0, math.ceil(math.log2(n_ranks / most)))
        if log <= 16:
            break
    need = ROW_KEYS * (PERIOD << log) // len(COVER)
    return min(max(need, CHUNK_BYTES[0]), CHUNK_BYTES[1]), log


def string_keys(text: np.ndarray, length: int, mixed=None) -> np.ndarray:
    """Keys of all substrings of this many bytes, by doubling: of 64 bits, or what ``mixed`` makes of the text's type."""
    n = len(text) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    mixed = mixed or _mixed
    done, keys, size, power = 0, None, 1, text.astype(np.uint64) if mixed is _mixed else text
    bits = length
    while bits:
        if bits & 1:
            part = power[done : done + n]
            keys = part.copy() if keys is None else mixed(keys, part)
            done += size
        bits >>= 1
        if bits:
            power, size = mixed(power[:-size], power[size:]), size * 2
    return keys


def _checked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The second hash, of 32 bits."""
    out = a * np.uint32(0x85EBCA6B)
    out ^= out >> np.uint32(15)
    out += b
    out *= np.uint32(0xC2B2AE35)
    out ^= out >> np.uint32(13)
    return out


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * _A
    out += b
    out ^= out >> _S
    out *= _B
    out ^= out >> _S
    return out


def _remixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The second half of 128-bit keys."""
    out = a * np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    out += b
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(31)
    return out


class Chunk:
    """The texts of consecutive documents."""

    def __init__(self, sizes: list[int], frame: bytes):
        """``sizes``: bytes of each text, negative for a copy, whose text is left out."""
        self.sizes = np.maximum(np.array(sizes, np.int64), 0)
        self.text = np.frombuffer(zstandard.decompress(frame), np.uint8)
        self.ends = np.cumsum(self.sizes)

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """(place of the first byte, text) of each document."""
        for end, size in zip(self.ends.tolist(), self.sizes.tolist(), strict=True):
            yield end - size, self.text[end - size : end]

    def cover(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of the cover positions of all documents."""
        size = LENGTH - PERIOD + 1
        places, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for first, text in self.documents():
            own = string_keys(text, size)
            at = (np.arange(0, len(own), PERIOD)[:, None] + np.array(COVER)).reshape(-1)
            at = at[at < len(own)]
            places.append(first + at)
            keys.append(own[at])
        return np.concatenate(places), np.concatenate(keys)

    def segments(self, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First places, numbers of suffixes and least grams of the segments of suffixes within reach of a tied cover position."""
        firsts, counts, grams = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
        bounds = np.searchsorted(tied, np.concatenate(([0], self.ends)))
        for k, (first, text) in enumerate(self.documents()):
            n = len(text) - LENGTH + 1
            if n <= 0 or bounds[k] == bounds[k + 1]:
                continue
            at = tied[bounds[k] : bounds[k + 1]] - first
            step = np.zeros(len(text) + 1, np.int32)
            np.add.at(step, np.maximum(at - PERIOD + 1, 0), 1)
            np.add.at(step, at + 1, -1)
            near = np.flatnonzero(np.cumsum(step[:n]) > 0)
            least = least_of(string_keys(text.astype(np.uint32), GRAM, _checked), LENGTH - GRAM + 1)[near]
            new = np.ones(len(near), bool)
            new[1:] = (near[1:] != near[:-1] + 1) | (least[1:] != least[:-1])
            starts = np.flatnonzero(new)
            firsts.append(first + near[starts])
            counts.append(np.diff(starts, append=len(near)))
            grams.append(least[starts])
        return np.concatenate(firsts), np.concatenate(counts), np.concatenate(grams)


def least_of(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` consecutive values: of what is left of one block of that size and the start of the next."""
    n = len(values) - size + 1
    blocks = np.concatenate([values, np.full(-len(values) % size, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, size)
    left = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    start = np.minimum.accumulate(blocks, 1).reshape(-1)
    return np.minimum(left[:n], start[size - 1 : size - 1 + n])


def spread(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``counts`` consecutive numbers from each of ``firsts``."""
    return np.repeat(firsts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def own_segments(own: Chunk, tied: np.ndarray, log: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's segments: first places and numbers of suffixes, and of the different ones in the order of their buckets: texts, indices, buckets; and the indices of repeats."""
    firsts, counts, grams = own.segments(tied)
    text, seen, new = own.text.tobytes(), set(), np.zeros(len(firsts), bool)
    texts = []
    for k, (a, n) in enumerate(zip(firsts.tolist(), counts.tolist(), strict=True)):
        piece = text[a : a + n + LENGTH - 1]
        if piece not in seen:
            seen.add(piece)
            texts.append(piece)
            new[k] = True
    chosen = np.flatnonzero(new)
    buckets = ((grams[chosen] * np.uint32(0x9E3779B1)).astype(np.uint64) >> np.uint64(32 - log)).astype(np.int64)
    order = np.argsort(buckets, kind="stable")
    return firsts, counts, [texts[k] for k in order.tolist()], chosen[order], buckets[order], np.flatnonzero(~new)


def words_of(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a number whose order is theirs."""
    n = len(text) - 7
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out <<= np.uint64(8)
        out |= text[k : k + n]
    return out


def sorted_by(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of numbers below ``2 ** bits``, and which ones in it equal the one before."""
    width = max(1, (len(values) - 1).bit_length())
    if bits + width <= 64:  # a number and its place fit into one: sorting these is much faster than sorting places
        both = np.sort((values.astype(np.uint64) << np.uint64(width)) | np.arange(len(values), dtype=np.uint64))
        order, ranked = (both & np.uint64((1 << width) - 1)).astype(np.int64), both >> np.uint64(width)
    else:
        order = np.argsort(values, kind="stable")
        ranked = values[order]
    return order, ranked[1:] == ranked[:-1]


def ranks_of(values: np.ndarray, bits: int) -> np.ndarray:
    """Dense ranks: equal for equal numbers, in their order."""
    order, same = sorted_by(values, bits)
    out = np.zeros(len(values), np.uint64)
    out[order[1:]] = np.cumsum(~same)
    return out


def cover_ranks(words: np.ndarray) -> np.ndarray:
    """For the positions of the small cover, the rank of the 13 steps (91 bytes) from there."""
    # A residue's positions are a step apart, so that a string of more steps is two ranked ones.
    own_words = [words[r::STEP] for r in SMALL]
    cuts = np.cumsum([len(w) for w in own_words])[:-1]
    flat = np.concatenate(own_words)
    width = np.uint64(max(1, len(flat).bit_length()))
    five = ranks_of(flat >> np.uint64(24), 40)
    ranks = np.split(ranks_of((five << np.uint64(16)) | (flat >> np.uint64(8)) & np.uint64(0xFFFF), int(width) + 16), cuts)
    for ahead in (1, 2, 4, 5):
        pairs = [(r[: max(len(r) - ahead, 0)] << width) | r[ahead:] for r in ranks]
        ranks = np.split(ranks_of(np.concatenate(pairs), 2 * int(width)), np.cumsum([len(p) for p in pairs])[:-1])
    out = np.zeros(len(words), np.uint32)
    for r, own in zip(SMALL, ranks, strict=True):
        out[r : r + STEP * len(own) : STEP] = own
    return out


def later_suffixes(texts: list[bytes], key_bits: int = 32) -> np.ndarray:
    """Which of the texts' suffixes of ``LENGTH`` bytes or more tie, over these, with an earlier one, in the texts' order."""
    text = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    at = spread(np.cumsum(sizes) - sizes, sizes - LENGTH + 1)
    out = np.zeros(len(at), bool)
    if not len(at):
        return out
    order, same = sorted_by(string_keys(text.astype(np.uint32), LENGTH, _checked)[at] >> np.uint32(32 - key_bits), key_bits)
    if not same.any():
        return out
    i, j = order[:-1][same], order[1:][same]
    p, q = at[i], at[j]
    words = words_of(text)
    ranks, meet = cover_ranks(words), _MEET[p % STEP, q % STEP]
    tie = (words[p] == words[q]) & (ranks[p + meet] == ranks[q + meet])
    for tail in (LENGTH - 16, LENGTH - 8):
        tie &= words[p + tail] == words[q + tail]
    out[j[tie]] = True
    if not tie.all():  # different strings of one hash: their groups are told apart by the strings themselves
        groups = np.concatenate(([0], np.cumsum(~same)))
        for g in np.unique(groups[1:][same][~tie]).tolist():
            seen = set()
            for k in order[np.searchsorted(groups, g) : np.searchsorted(groups, g, "right")].tolist():
                piece = text[at[k] : at[k] + LENGTH].tobytes()
                out[k] = piece in seen
                seen.add(piece)
    return out


def packed(keys: np.ndarray, twice: np.ndarray | None = None) -> bytes:
    """Sorted keys as byte planes of their differences, compressed."""
    gaps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    raw = np.ascontiguousarray(gaps.T).tobytes() + (b"" if twice is None else np.packbits(twice).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked(frame: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(frame), np.uint8)
    gaps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).reshape(-1)
    return np.cumsum(gaps, dtype=np.uint64), np.unpackbits(raw[8 * n :], count=n) if len(raw) > 8 * n else np.zeros(n, np.uint8)


def copies(rows: DataFrame) -> DataFrame:
    """``doc_id, key`` of the texts that an earlier document has too; shorter ones than ``LENGTH`` don't matter."""
    salts = 32  # a text may be a third of all rows: they are dealt over salts, the row of its first document repeated
    hashed = rows.where(F.octet_length("text") >= LENGTH).select("doc_id", "key", F.md5("text").alias("md5"))
    place = F.struct("doc_id", "key")
    first = hashed.groupBy("md5").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last")))
    first = first.select(F.col("md5").alias("_md5"), "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    salted = hashed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(salts)).cast("int"))
    later = salted.join(first, (F.col("md5") == F.col("_md5")) & (F.col("salt") == F.col("_salt"))).where(~place.eqNullSafe(F.col("first")))
    return later.select("doc_id", "key")


def chunked(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Chunks of whole documents in the order of doc_id (null first), then text key.

    The sizes of whole-text copies are negative; their texts are left out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ["chunk", "doc_ids", "sizes", "frame"]

    def run(batches):
        part, number, held, keys, sizes, texts = TaskContext.get().partitionId(), 0, 0, [], [], []
        packer, marked, last = zstandard.ZstdCompressor(level=3), None, None

        def chunk():
            frame = packer.compress(b"".join(texts))
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) | number], pa.int64()), pa.array([keys], pa.list_(key_kind)), pa.array([sizes], pa.list_(pa.int64())), pa.array([frame], pa.binary())], fields
            )

        for batch in batches:
            key_kind = batch.column(0).type
            for doc_id, key, is_mark, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if is_mark:
                    marked = (doc_id, key)
                    continue
                text = text or b""
                copy = len(text) >= LENGTH and ((doc_id, key) == marked or (doc_id, text) == last)
                last = (doc_id, text)
                keys.append(doc_id)
                sizes.append(-len(text) if copy else len(text))
                held += 64
                if not copy:
                    texts.append(text)
                    held += len(text)
                if held >= chunk_bytes:
                    yield chunk()
                    number, held, keys, sizes, texts = number + 1, 0, [], [], []
        if keys:
            yield chunk()

    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.lit(False).alias("mark"), F.col("text").cast("binary").alias("text"))
    marks = copies(rows).distinct().select("doc_id", "key", F.lit(True).alias("mark"), F.lit(None).cast("binary").alias("text"))
    # A copy's mark meets it in the shuffle that puts the texts in order: it stands right before it.
    order = (F.col("doc_id").asc_nulls_first(), F.col("key"))
    both = rows.unionByName(marks).repartitionByRange(*order).sortWithinPartitions(*order, F.col("mark").desc())
    return settle(both.mapInArrow(run, f"chunk long, doc_ids array<{kind}>, sizes array<long>, frame binary"))


def _sorted_buckets(blocks: DataFrame, rule) -> DataFrame:
    """Sort one bucket at a time; ``rule(keys, twice)`` marks entries, and the masks go back to their chunks.

    ``blocks`` has ``chunk, bucket, n, frame``.
    """

    def run(key, table):
        chunks, n = np.array(table["chunk"].to_pylist(), np.int64), table["n"].to_pylist()
        order = np.argsort(chunks, kind="stable")
        parts = [unpacked(table["frame"][int(i)].as_py(), n[i]) for i in order]
        sizes = [n[i] for i in order]
        marked = rule(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        masks = [np.packbits(m).tobytes() for m in np.split(marked, np.cumsum(sizes)[:-1])]
        return pa.table({"chunk": pa.array(chunks[order]), "bucket": pa.array([key[0].as_py()] * len(order), pa.int32()), "n": pa.array(sizes, pa.int64()), "mask": pa.array(masks, pa.binary())})

    return blocks.groupBy("bucket").applyInArrow(run, "chunk long, bucket int, n long, mask binary")


def repeated_rule(keys: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Cover ranks held more than once, in one chunk or in several."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = twice.astype(bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


_BLOCK = "chunk long, bucket int, n long, frame binary"
_KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.binary())


def _blocks(chunk: int, keys: np.ndarray, buckets: np.ndarray, twice: np.ndarray | None = None) -> pa.RecordBatch:
    """A chunk's distinct keys in the order of bucket and key, a row for each bucket that has any."""
    bounds = [*np.flatnonzero(np.diff(buckets, prepend=buckets[:1])).tolist(), len(keys)]
    if bounds[0]:
        bounds.insert(0, 0)
    rows = [
        (chunk, int(buckets[a]), b - a, packed(keys[a:b], None if twice is None else twice[a:b]))
        for a, b in zip(bounds, bounds[1:], strict=False)
    ]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], ["chunk", "bucket", "n", "frame"])


def _marks(masks: list[dict] | None) -> np.ndarray:
    """The marks of all buckets, in the order of bucket and, in it, of what the chunk sent."""
    parts = [np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=m["n"]) for m in sorted(masks or [], key=lambda m: m["bucket"])]
    return np.concatenate([*parts, np.empty(0, np.uint8)]).astype(bool)


def _gathered(masks: DataFrame, name: str) -> DataFrame:
    """Each chunk's masks in one row."""
    return masks.groupBy(F.col("chunk").alias(f"_{name}")).agg(F.collect_list(F.struct("bucket", "n", "mask")).alias(name))


def _sorted_segments(segments: DataFrame) -> DataFrame:
    """Masks of the suffixes of each chunk and bucket that tie with an earlier one; ``segments`` has ``chunk, bucket, counts, text``."""

    def run(key, table):
        chunks = np.array(table["chunk"].to_pylist(), np.int64)
        order = np.argsort(chunks, kind="stable")
        counts = [np.frombuffer(table["counts"][int(i)].as_py(), np.uint32).astype(np.int64) for i in order]
        seen, new, texts = set(), [], []
        for i, n in zip(order.tolist(), counts, strict=True):
            text, a = table["text"][i].as_py(), 0
            for size in (n + LENGTH - 1).tolist():
                piece = text[a : a + size]
                a += size
                new.append(piece not in seen)
                if new[-1]:
                    seen.add(piece)
                    texts.append(piece)
        # All suffixes of a segment that was there before tie.
        marked = np.ones(sum(int(n.sum()) for n in counts), bool)
        marked[np.repeat(np.array(new, bool), np.concatenate(counts))] = later_suffixes(texts)
        sizes = [int(n.sum()) for n in counts]
        masks = [np.packbits(m).tobytes() for m in np.split(marked, np.cumsum(sizes)[:-1])]
        return pa.table({"chunk": pa.array(chunks[order]), "bucket": pa.array([key[0].as_py()] * len(order), pa.int32()), "n": pa.array(sizes, pa.int64()), "mask": pa.array(masks, pa.binary())})

    return segments.groupBy("bucket").applyInArrow(run, "chunk long, bucket int, n long, mask binary")


def heavy_buckets(segments: DataFrame) -> DataFrame:
    """``_bucket`` of the buckets whose segments outgrow a task; there is one for each ``HEAVY`` bytes of segments at most."""
    held = segments.groupBy(F.col("bucket").alias("_bucket")).agg(F.sum("bytes").alias("_bytes"))
    total, n = held.agg(F.sum("_bytes"), F.count("*")).first()
    return held.where(F.col("_bytes") > max(HEAVY, HEAVY_MEANS * (total or 0) // max(1, n))).select("_bucket")


def suffix_keys(counts: bytes, text: bytes) -> np.ndarray:
    """128-bit keys, as pairs of numbers, of the suffixes of segments that follow each other."""
    n = np.frombuffer(counts, np.uint32).astype(np.int64)
    sizes = n + LENGTH - 1
    at = spread(np.cumsum(sizes) - sizes, n)
    raw = np.frombuffer(text, np.uint8)
    out = np.empty(len(at), [("a", np.uint64), ("b", np.uint64)])
    out["a"] = string_keys(raw, LENGTH)[at]
    out["b"] = string_keys(raw.astype(np.uint64), LENGTH, _remixed)[at]
    return out


def different(counts: bytes, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order, where each comes first, and the number of each suffix's key."""
    return np.unique(suffix_keys(counts, text), return_index=True, return_inverse=True)


def keys_in_ranges(heavy: DataFrame, log: int) -> DataFrame:
    """``chunk, bucket, range, n, keys``: what each row of heavy segments holds of each of ``2 ** log`` ranges of keys, once."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, bucket, counts, text = (batch.column(i)[k].as_py() for i in range(4))
                keys, _, _ = different(counts, text)
                ranges = (keys["a"] >> np.uint64(64 - log)).astype(np.int64) if log else np.zeros(len(keys), np.int64)
                edges = [*np.flatnonzero(np.diff(ranges, prepend=-1)).tolist(), len(keys)]
                rows = [(chunk, bucket, int(ranges[a]), b - a, keys[a:b].tobytes()) for a, b in zip(edges, edges[1:], strict=False)]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["chunk", "bucket", "range", "n", "keys"])

    return heavy.select("chunk", "bucket", "counts", "text").mapInArrow(run, "chunk long, bucket int, range int, n long, keys binary")


def _later_keys(ranged: DataFrame) -> DataFrame:
    """``chunk, bucket, range, n, mask``: which keys an earlier chunk holds too; equal suffixes have equal buckets."""

    def run(key, table):
        chunks, n = np.array(table["chunk"].to_pylist(), np.int64), table["n"].to_pylist()
        order = np.argsort(chunks, kind="stable").tolist()
        keys = np.frombuffer(b"".join(table["keys"][i].as_py() for i in order), [("a", np.uint64), ("b", np.uint64)])
        place = np.lexsort((keys["b"], keys["a"]))  # stable: of equal keys the earliest chunk's comes first
        ranked = keys[place]
        later = np.zeros(len(keys), bool)
        later[place[1:]] = ranked[1:] == ranked[:-1]
        masks = [np.packbits(m).tobytes() for m in np.split(later, np.cumsum([n[i] for i in order])[:-1])]
        head = table.select(["chunk", "bucket", "range", "n"]).take(pa.array(order))
        return head.append_column("mask", pa.array(masks, pa.binary()))

    return ranged.groupBy("range").applyInArrow(run, "chunk long, bucket int, range int, n long, mask binary")


def _sorted_heavy(heavy: DataFrame, suffixes: int) -> DataFrame:
    """As :func:`_sorted_segments`, for buckets of any size."""
    log = max(0, math.ceil(math.log2(max(1, suffixes) / RANGE_KEYS)))
    masks = _later_keys(keys_in_ranges(heavy, log))
    gathered = masks.groupBy(F.col("chunk").alias("_chunk"), F.col("bucket").alias("_bucket")).agg(F.collect_list(F.struct("range", "n", "mask")).alias("masks"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, bucket, counts, text, masks = (batch.column(i)[k].as_py() for i in range(5))
                _, first, inverse = different(counts, text)
                parts = [np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=m["n"]) for m in sorted(masks, key=lambda m: m["range"])]
                later = np.concatenate(parts).astype(bool)[inverse]
                again = np.ones(len(inverse), bool)
                again[first] = False
                out = np.packbits(later | again).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), pa.array([len(inverse)], pa.int64()), pa.array([out], pa.binary())], ["chunk", "bucket", "n", "mask"]
                )

    both = heavy.join(gathered, (F.col("chunk") == F.col("_chunk")) & (F.col("bucket") == F.col("_bucket")))
    return both.select("chunk", "bucket", "counts", "text", "masks").mapInArrow(run, "chunk long, bucket int, n long, mask binary")


def find_repeats(docs: DataFrame, *, chunk_bytes: int | None = None, log_buckets: int | None = None, digest: bool = False) -> DataFrame:
    """The bytes of each text that a string of ``LENGTH`` bytes covers which also starts earlier.

    Earlier is a smaller doc_id (null first), at equal doc_ids a smaller text
    key, in one text a smaller offset; equal rows come one after the other. Texts
    are UTF-8 bytes, a null text is empty; strings never cross texts and are
    judged on the input. Returns ``doc_id, n_bytes, spans`` (array of ``start,
    end`` in bytes), or, as a digest, ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    The result is exact: keys of cover positions, of as many bits as make one in a thousand of them tie by
    chance, only cost work, and suffixes that tie are compared by their bytes and by exact ranks; those of split buckets by 128-bit keys. A text is held whole, about 60 bytes for each of its own.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    planned = layout(total)
    chunk_bytes, log = chunk_bytes or planned[0], planned[1] if log_buckets is None else log_buckets
    chunks = chunked(docs, chunk_bytes)
    bits = min(64, (total * len(COVER) // PERIOD + 1).bit_length() + 10)
    shift = np.uint64(64 - bits)
    doc_kind = docs.schema["doc_id"].dataType.simpleString()

    def rank(batches):
        for batch in batches:
            for chunk, sizes, frame in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys, times = np.unique(Chunk(sizes, frame).cover()[1] >> shift, return_counts=True)
                if len(keys):
                    yield _blocks(chunk, keys, keys >> np.uint64(bits - log), times > 1)

    def tied(own: Chunk, ranks) -> np.ndarray:
        places, keys = own.cover()
        inverse = np.unique(keys >> shift, return_inverse=True)[1]
        return places[_marks(ranks)[inverse]]

    def send(batches):
        for batch in batches:
            for sizes, frame, ranks, chunk in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = Chunk(sizes, frame)
                _, counts, texts, chosen, buckets, _ = own_segments(own, tied(own, ranks), log)
                edges = [*np.flatnonzero(np.diff(buckets, prepend=-1)).tolist(), len(buckets)]
                joined = [b"".join(texts[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
                rows = [(chunk, int(buckets[a]), counts[chosen[a:b]].astype(np.uint32).tobytes(), t, len(t)) for a, b, t in zip(edges, edges[1:], joined, strict=False)]
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["chunk", "bucket", "counts", "text", "bytes"])

    def cover(batches):
        for batch in batches:
            for sizes, frame, ranks, later, doc_ids in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                own = Chunk(sizes, frame)
                firsts, counts, _, chosen, _, others = own_segments(own, tied(own, ranks), log)
                starts = np.concatenate([spread(firsts[chosen], counts[chosen])[_marks(later)], spread(firsts[others], counts[others])])
                step = np.zeros(len(own.text) + LENGTH + 1, np.int64)
                step[: len(own.text) + 1] += np.bincount(starts, minlength=len(own.text) + 1)
                step[LENGTH:] -= np.bincount(starts, minlength=len(own.text) + 1)
                gone = np.cumsum(step)[: len(own.text)] > 0
                yield results(doc_ids, sizes, own, gone, batch.schema.field(4).type.value_type)

    def results(doc_ids, sizes, own: Chunk, gone: np.ndarray, kind) -> pa.RecordBatch:
        spans, kept = [], []
        for size, (first, text) in zip(sizes, own.documents(), strict=True):
            if size < 0:
                spans.append([(0, -size)])
                kept.append(hashlib.sha256(b"").hexdigest())
                continue
            mask = gone[first : first + len(text)]
            edges = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
            spans.append(list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)))
            kept.append(hashlib.sha256((text[~mask] if len(edges) else text).tobytes()).hexdigest())
        head = [pa.array(doc_ids, kind), pa.array([abs(x) for x in sizes], pa.int64())]
        if not digest:
            rows = [[{"start": a, "end": b} for a, b in s] for s in spans]
            return pa.RecordBatch.from_arrays([*head, pa.array(rows, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "n_bytes", "spans"])
        counts = [pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()), pa.array([len(s) for s in spans], pa.int64())]
        return pa.RecordBatch.from_arrays([*head, *counts, pa.array(kept)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    ranks = settle(_gathered(_sorted_buckets(chunks.select("chunk", "sizes", "frame").mapInArrow(rank, _BLOCK), repeated_rule), "ranks"))
    # Both uses of this join read the same columns, so that they share its shuffles; the next join on the chunk needs none for it.
    ranked = chunks.join(ranks, F.col("chunk") == F.col("_ranks"), "left").drop("_ranks")
    sent = ranked.select("sizes", "frame", "ranks", "chunk", "doc_ids").mapInArrow(send, "chunk long, bucket int, counts binary, text binary, bytes long")
    folder = f"{shared_folder(docs.sparkSession)}/segments-{uuid.uuid4().hex}"
    sent.write.option("compression", "zstd").parquet(folder)
    segments = docs.sparkSession.read.parquet(folder)
    outgrown = F.broadcast(heavy_buckets(segments))  # a few bytes for each HEAVY bytes of segments
    at = F.col("bucket") == F.col("_bucket")
    heavy = segments.join(outgrown, at, "left_semi")
    suffixes = heavy.agg(F.sum("bytes")).first()[0] or 0  # no more than their bytes
    masks = _sorted_segments(segments.join(outgrown, at, "left_anti"))
    if suffixes:
        masks = masks.unionByName(_sorted_heavy(heavy, suffixes))
    later = _gathered(masks, "later")
    joined = ranked.join(later, F.col("chunk") == F.col("_later"), "left")
    last = "n_removed long, n_spans long, kept_sha256 string" if digest else "spans array<struct<start:long,end:long>>"
    return joined.select("sizes", "frame", "ranks", "later", "doc_ids").mapInArrow(cover, f"doc_id {doc_kind}, n_bytes long, {last}")
