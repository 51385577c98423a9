"""Secret scans: fixed patterns, and automata inferred from the credentials that these label.

Per kind, a prefix tree of character classes is grown from a bounded sample of
labelled credentials, and states of which what follows is statistically
compatible (likelihood ratios, at every distance ahead) are merged into a
probabilistic automaton. Every other token of six characters or more is a candidate: it
is a secret of the kind ``format`` if one automaton makes it likelier, a character, than a
background model of all candidates does, by no less than all but a twentieth of
the labelled ones do.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import settle, text_key

KINDS = ("assign", "access", "hex", "format")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_NAMES = re.compile(rb"passw|secret|token|api_?key", re.I)
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_.=-]{6,}")
#: Labelled credentials of each kind from which automata are learnt; the smallest hashes of the whole corpus.
SAMPLE = 600
#: Only credentials of at most this many characters are learnt from; longer ones are scored like the others.
LONGEST = 256
#: Distinct words that a task counts or judges at a time.
CACHED_WORDS = 200_000
_CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/", "_", ".", "=", "-")
_CLASS_OF = np.full(256, 255, np.uint8)
for _n, _c in enumerate(_CLASSES):
    _CLASS_OF[list(_c.encode())] = _n
_WITHIN = [-math.log2(len(c)) for c in _CLASSES]


def base_spans(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """(start, number of the kind, end, credential) in bytes, sorted."""
    out = []
    if _NAMES.search(text):
        out += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: bytes, taken: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, bytes]]:
    """(start, end, token) of the maximal runs of six characters or more that no pattern's span overlaps."""
    out = [(m.start(), m.end(), m[0]) for m in _CANDIDATE.finditer(text)]
    return [x for x in out if not any(a < x[1] and x[0] < b for a, _, b, _ in taken)] if taken else out


def code_points(text: bytes, at: list[int]) -> list[int]:
    """Byte offsets as code point offsets."""
    if not at or text.isascii():
        return at
    first = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return [int(first[x - 1]) if x else 0 for x in at]


class Automaton:
    """A probabilistic automaton over character classes, merged from the prefix tree of some words.

    A state is what follows it: the suffixes of words that reach it. Those of one state are
    counted by how far ahead they lie, their ends and their classes at each distance. Two states
    are compatible if no such share differs by a likelihood-ratio test, so that what single deep states of
    the tree can't show, such as the words' length, is seen by all of them together. What follows the
    states settled first is taken first, so that all of one distance have met before the next; each joins the nearest compatible settled state, or settles itself.
    """

    def __init__(self, words: list[bytes], alpha: float = 0.05):
        self.codes = np.concatenate([_CLASS_OF[np.frombuffer(b"".join(words), np.uint8)], [0]]).astype(np.int64)
        self.ends = np.cumsum([len(w) for w in words])
        self.starts = self.ends - np.array([len(w) for w in words])
        self.reach = int(max(len(w) for w in words)) + 1
        tests = self.reach * (len(_CLASSES) + 1)
        self.limit = 2 * math.log(1 / (alpha / tests))  # about the quantile of a chi-square of one degree
        values = np.arange(1, len(self.codes) + len(words) + 1)
        self.xlogx = np.concatenate(([0.0], values * np.log(values)))
        self._merge(len(words))
        self._fix()

    def _profile(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each distance ahead, how many suffixes end there, and are of each class there."""
        left = self.ends[word] - at
        k = len(_CLASSES) + 1
        first = np.repeat(np.cumsum(left) - left, left)
        ahead = np.arange(int(left.sum())) - first
        cells = np.concatenate([ahead * k + self.codes[np.repeat(at, left) + ahead], left * k + k - 1])
        return np.bincount(cells, minlength=self.reach * k).reshape(self.reach, k)

    def _apart(self, x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Likelihood ratios of ``x`` of ``n`` against ``y`` of ``m``."""
        f = self.xlogx
        return 2 * (f[x] + f[n - x] + f[y] + f[m - y] - f[n] - f[m] - f[x + y] - f[n + m - x - y] + f[n + m])

    def _merge(self, n: int) -> None:
        profiles: list[np.ndarray] = []
        self.next: list[dict[int, int]] = []
        waiting: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

        def settle_at(state: int, word: np.ndarray, at: np.ndarray) -> None:
            """Suffixes join a settled state, and what follows them the states after it."""
            stack = [(state, word, at)]
            while stack:
                state, word, at = stack.pop()
                profiles[state] += self._profile(word, at)
                going = at < self.ends[word]
                word, at = word[going], at[going]
                classes = self.codes[at]
                for c in np.unique(classes).tolist():
                    own = classes == c
                    if c in self.next[state]:
                        stack.append((self.next[state][c], word[own], at[own] + 1))
                    else:
                        held = waiting.get((state, c), (word[:0], at[:0]))
                        waiting[state, c] = np.concatenate([held[0], word[own]]), np.concatenate([held[1], at[own] + 1])

        def settled() -> int:
            profiles.append(np.zeros((self.reach, len(_CLASSES) + 1), np.int64))
            self.next.append({})
            return len(profiles) - 1

        settle_at(settled(), np.arange(n), self.starts)
        while waiting:
            key = max(waiting, key=lambda k: (-k[0], len(waiting[k][0]), -k[1]))
            word, at = waiting.pop(key)
            own = self._profile(word, at)
            # By their ends first, which leaves few states for all classes.
            ends = np.stack([p[:, -1] for p in profiles])
            reached = ends[:, ::-1].cumsum(1)[:, ::-1]
            far = self._apart(own[:, -1], self._left(own), ends, reached).max(1)
            best, nearest = None, self.limit
            for state in np.flatnonzero(far <= self.limit).tolist():
                of, total = profiles[state], self._left(profiles[state])
                gap = float(self._apart(own, self._left(own)[:, None], of, total[:, None]).max())
                if gap <= nearest and (best is None or gap < nearest):
                    best, nearest = state, gap
            if best is None:
                best = settled()
            self.next[key[0]][key[1]] = best
            settle_at(best, word, at)
        self.states = range(len(profiles))
        self.profiles = profiles

    @staticmethod
    def _left(profile: np.ndarray) -> np.ndarray:
        """How many suffixes go so far: those that end there or later."""
        return profile[:, -1][::-1].cumsum()[::-1]

    def _fix(self) -> None:
        # Half an occurrence is added to each class and to the end, so that few words give a broad automaton.
        seen = np.array([p[0] for p in self.profiles]) + 0.5
        chances = np.log2(seen / seen.sum(1, keepdims=True))
        self.log, self.stop = chances[:, :-1] + np.array(_WITHIN), chances[:, -1]
        self.move = np.zeros((len(self.next), len(_CLASSES)), np.int64)  # what no sample has restarts
        for s, moves in enumerate(self.next):
            for c, t in moves.items():
                self.move[s, c] = t
        del self.profiles, self.codes, self.starts, self.ends, self.xlogx

    def scores(self, words: list[bytes]) -> np.ndarray:
        """log2 likelihoods a character, all words a step at a time."""
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-sizes, kind="stable")
        codes = _CLASS_OF[np.frombuffer(b"".join(words), np.uint8)].astype(np.int64)
        at = (np.cumsum(sizes) - sizes)[order]
        active = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), "left")  # words longer than so many steps
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words))
        for step, n in enumerate(active.tolist()):
            c = codes[at[:n] + step]
            total[:n] += self.log[state[:n], c]
            state[:n] = self.move[state[:n], c]
        out = np.empty(len(words))
        out[order] = (total + self.stop[state]) / (sizes[order] + 1)
        return out

    def score(self, word: bytes) -> float:
        return float(self.scores([word])[0])


def moves(words: Counter) -> np.ndarray:
    """How often a class follows a class in the words, each as often as it is counted; the ends are a class of their own."""
    k = len(_CLASSES) + 1
    if not words:
        return np.zeros((k, k), np.int64)
    c = np.minimum(_CLASS_OF, k - 1)[np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)].astype(np.int64)
    times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 1)
    return np.bincount(c[:-1] * k + c[1:], times, k * k).astype(np.int64).reshape(k, k)


class Background:
    """Ordinary tokens: chances of a class after a class, with one added to each count."""

    def __init__(self, counts: np.ndarray):
        n = counts + 1.0
        self.log = np.log2(n / n.sum(1, keepdims=True)) + np.array([*_WITHIN, 0.0])

    def scores(self, words: list[bytes]) -> np.ndarray:
        k = len(_CLASSES)
        c = np.minimum(_CLASS_OF, k)[np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)]
        steps = self.log[c[:-1], c[1:]]
        sizes = np.array([len(w) for w in words], np.int64) + 1
        return np.add.reduceat(steps, np.cumsum(sizes) - sizes) / sizes


class Formats:
    """Automata of the kinds that have samples, and their thresholds."""

    def __init__(self, labelled: dict[str, list[bytes]], ordinary: np.ndarray):
        self.background = Background(ordinary)
        self.kinds: list[tuple[Automaton, float]] = []
        for _, words in sorted(labelled.items()):
            if words:
                a = Automaton(words)
                own = a.scores(words) - self.background.scores(words)
                # Ordinary tokens may hold unlabelled secrets: they give the background, not a bar.
                self.kinds.append((a, max(0.0, float(np.quantile(own, 0.05)))))

    def secret(self, words: list[bytes]) -> np.ndarray:
        """Which of the words are secrets."""
        out = np.zeros(len(words), bool)
        if self.kinds and words:
            ground = self.background.scores(words)
            for a, bar in self.kinds:
                more = a.scores(words) - ground
                out |= (more > 0) & (more >= bar - 1e-9)
        return out


def _sample(values: DataFrame, n: int) -> list[bytes]:
    """The ``n`` distinct values of the smallest hashes; a top-k over the whole corpus."""
    distinct = values.select("value").distinct()
    return sorted(bytes(r["value"]) for r in distinct.orderBy(F.xxhash64("value"), "value").limit(n).collect())


def scan(docs: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """Spans of secrets in every whole text.

    Returns ``doc_id, text_key, spans`` (array of ``start, kind, end``; ``kind``
    as numbered in ``KINDS``; code points, end exclusive), sorted by start, then kind.
    The patterns' spans all stay. A null text is empty. Rows that repeat are
    scanned each. A kind without a labelled credential of at most ``LONGEST``
    characters has no automaton. Candidates of any length are scored.
    """
    spans_kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches):
        """Each task's labelled credentials (``kind, value``), and its candidates' class moves (``move, n``)."""
        total, words = np.zeros((len(_CLASSES) + 1,) * 2, np.int64), Counter()
        for batch in batches:
            labelled = set()
            for text in batch.column(0).to_pylist():
                base = base_spans(text or b"")
                labelled.update((k, v) for _, k, _, v in base)
                words.update(v for _, _, v in candidates(text or b"", base))
                if len(words) >= CACHED_WORDS:
                    total += moves(words)
                    words.clear()
            kinds, values = zip(*sorted(labelled), strict=True) if labelled else ((), ())
            none = pa.nulls(len(kinds), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(values, pa.binary()), none, none], ["kind", "value", "move", "n"])
        total = (total + moves(words)).reshape(-1)
        some = np.flatnonzero(total)
        none = pa.nulls(len(some))
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.binary()), pa.array(some, pa.int64()), pa.array(total[some])], ["kind", "value", "move", "n"])

    text = F.col("text")
    counted = settle(docs.select(text.cast("binary").alias("text")).mapInArrow(count, "kind long, value binary, move long, n long"))
    ordinary = np.zeros((len(_CLASSES) + 1) ** 2, np.int64)
    for r in counted.where("move IS NOT NULL").groupBy("move").agg(F.sum("n").alias("n")).collect():  # a row for each pair of classes
        ordinary[r["move"]] = r["n"]
    short = counted.where(F.octet_length("value") <= LONGEST)
    formats = Formats({KINDS[k]: _sample(short.where(F.col("kind") == k), sample) for k in range(3)}, ordinary.reshape(len(_CLASSES) + 1, -1))
    sent = docs.sparkSession.sparkContext.broadcast(formats)

    def score(batches):
        formats, known = sent.value, {}
        for batch in batches:
            spans, texts = [], [t or b"" for t in batch.column(2).to_pylist()]
            bases = [base_spans(t) for t in texts]
            tokens = [candidates(t, base) for t, base in zip(texts, bases, strict=True)]
            if len(known) >= CACHED_WORDS:
                known.clear()
            new = list({word for own in tokens for _, _, word in own} - known.keys())
            known.update(zip(new, formats.secret(new).tolist(), strict=True))
            for text, base, own in zip(texts, bases, tokens, strict=True):
                every = [(a, k, b) for a, k, b, _ in base]
                every += [(a, 3, b) for a, b, word in own if known[word]]
                every.sort(key=lambda x: x[:2])
                at = code_points(text, [x for a, _, b in every for x in (a, b)])
                spans.append([{"start": a, "kind": k, "end": b} for a, b, (_, k, _) in zip(at[::2], at[1::2], every, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, spans_kind)], ["doc_id", "text_key", "spans"])

    rows = docs.select("doc_id", text_key(text).alias("text_key"), text.cast("binary").alias("text"))
    return rows.mapInArrow(score, f"doc_id {kind}, text_key long, spans array<struct<start:long,kind:int,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    names = F.array(*(F.lit(k) for k in KINDS))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(line(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )
