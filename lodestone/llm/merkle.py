"""Merkle manifest of a table, with multiproofs by the octopus method.

Rows are leaves of a tree of their source, by threes; the sources' subroots
are the leaves of a tree above these. Leaves are numbered range by range and dealt into
blocks of ``3 ** HEIGHT`` that follow each other. A block knows every node below its own top,
so that only its tops and the nodes above them are kept as a table of coordinates (tree, level, index).

To prove its leaves, a block computes the smallest set of coordinates that it can't derive,
fetches these once, derives all that its leaves share, and then writes
each leaf's own proof. Proofs are verified by folding a leaf, which may be a tampered one, with its siblings.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from hashlib import sha256
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import join_dealt, shared_folder

ARITY = 3
#: Levels of a block, which has at most 3 ** 7 = 2187 leaves.
HEIGHT = 7
#: The tree of the subroots; those of the sources are numbered from 0.
TOP = -1
#: What a row's leaf is made of.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(fields: Sequence[Column]) -> Column:
    """Binary SHA-256 of the fields: each its bytes' count, a colon and its value, or a dash where it is null."""
    strings = [f.cast("string") for f in fields]
    parts = [F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)) for s in strings]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def without_newlines(doc_id: Column, text: Column) -> Column:
    """``text`` as tampered with: without its newlines where the checksum of the decimal doc_id is even; a null doc_id's is left alone."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def combined(nodes: Sequence[str]) -> str:
    return sha256("".join(nodes).encode("ascii")).hexdigest()


def missing(known: set[int], n: int) -> list[tuple[int, int]]:
    """Level and index of the fewest nodes with which the leaves ``known`` of a tree of ``n`` leaves give its root."""
    out, level = [], 0
    while n > 1:
        runs = {k // ARITY for k in known}
        out += [(level, c) for r in sorted(runs) for c in range(ARITY * r, min(ARITY * (r + 1), n)) if c not in known]
        known, n, level = runs, -(-n // ARITY), level + 1
    return out


def _height(n: int) -> int:
    level = 0
    while n > 1:
        n, level = -(-n // ARITY), level + 1
    return level


def _grouped(batches: Iterable[pa.RecordBatch], keys: int = 2) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows that follow each other and are equal in their first columns."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return groupby(rows, key=lambda r: r[:keys])


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, 4096)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _ordered(rows: DataFrame, by: Sequence[str], order: Sequence[str], folder: str) -> tuple[DataFrame, DataFrame]:
    """Rows written in order with their place ``_at``, and for each group and part the places before it and the group's rows.

    A group may be of any size; only a row for each part of it meets in one place.
    """
    places = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    rows.repartitionByRange(*places).sortWithinPartitions(*places).withColumn("_at", F.monotonically_increasing_id()).write.parquet(folder)
    held = rows.sparkSession.read.parquet(folder).withColumn("_part", F.shiftright("_at", 33))
    runs = held.groupBy(*by, "_part").agg(F.count("*").alias("_held"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_held").over(earlier), F.lit(0))
    return held, runs.withColumn("_shift", before - F.col("_first")).withColumn("n", F.sum("_held").over(Window.partitionBy(*by)))


def _in_blocks(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", *order)


_NODE = "tree long, level int, idx long, hash binary, n long"
_NODES = pa.schema([("tree", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("hash", pa.binary()), ("n", pa.int64())])
_TOPS = _NODES.append(pa.field("home_tree", pa.int64())).append(pa.field("home_block", pa.int64()))


def _climb(nodes: list[str], n: int, levels: int) -> Iterator[tuple[list[str], int]]:
    """The levels above a block's nodes and how many nodes of the tree each has, up to ``levels`` or the root."""
    while levels and n > 1:
        nodes = [combined(nodes[k : k + ARITY]) for k in range(0, len(nodes), ARITY)]
        n, levels = -(-n // ARITY), levels - 1
        yield nodes, n


def _tops_and_needs(leaves: DataFrame, n_trees: int) -> DataFrame:
    """Each block's top node, and the coordinates that it needs, without a hash."""

    def run(batches):
        def rows():
            for (tree, block), group in _grouped(batches):
                own = [(r[2], r[3].hex(), r[4]) for r in group]
                n, level = own[0][2], 0
                top, left = [own[0][1]], n
                for top, left in _climb([o[1] for o in own], n, HEIGHT):
                    level += 1
                yield tree, level, block, bytes.fromhex(top[0]), left, None, None
                needs = [(tree, *c) for c in missing({o[0] for o in own}, n)] + [(TOP, *c) for c in missing({tree}, n_trees)]
                for need in {*needs, (TOP, 0, tree), (TOP, _height(n_trees), 0)}:
                    yield *need, None, None, tree, block

        yield from _batches(rows(), _TOPS)

    return _in_blocks(leaves.select("tree", "block", "pos", "leaf", "n"), "pos").mapInArrow(run, f"{_NODE}, home_tree long, home_block long")


def _nodes_above(nodes: DataFrame, most: int, folder: str) -> list[DataFrame]:
    """``nodes`` (all of one level) and, written round by round, all that stand above them; no tree has more than ``most`` of them."""

    def run(batches):
        def rows():
            for (tree, block), group in _grouped(batches):
                own = [(r[2], r[3], r[4].hex(), r[5]) for r in group]
                level, first = own[0][:2]
                for above, left in _climb([o[2] for o in own], own[0][3], HEIGHT):
                    level, first = level + 1, first // ARITY
                    for k, h in enumerate(above):
                        yield tree, level, first + k, bytes.fromhex(h), left

        yield from _batches(rows(), _NODES)

    out = [nodes]
    while most > 1:
        blocks = nodes.where("n > 1").withColumn("block", F.expr(f"idx div {ARITY**HEIGHT}")).select("tree", "block", "level", "idx", "hash", "n")
        at = f"{folder}/{len(out)}"
        _in_blocks(blocks, "idx").mapInArrow(run, _NODE).write.parquet(at)
        above = nodes.sparkSession.read.parquet(at)
        out.append(above)
        # The next round starts from the blocks' tops; a tree whose root was reached takes no part in it.
        top = blocks.select(F.max("level")).first()[0] + HEIGHT
        nodes, most = above.where(F.col("level") == top), -(-most // ARITY**HEIGHT)
    return out


class _Block:
    """What a block derives from its leaves and the nodes it has fetched: for every node of its own the siblings beside it, and what follows above."""

    def __init__(self, tree: int, leaves: dict[int, str], n: int, n_trees: int, fetched: dict[tuple[int, int, int], str]):
        self.beside: list[dict[int, tuple[str, str]]] = []
        own = self._climb(tree, leaves, n, fetched)
        self.subroot = own
        self.first_above = len(self.beside)
        self._climb(TOP, {tree: own}, n_trees, fetched)
        self.tree = tree
        self.above: dict[int, str] = {}
        for at in range(len(self.beside) - 1, -1, -1):
            self.above = {k: left + right + self.above.get(self._parent(at, k), "") for k, (left, right) in self.beside[at].items()}

    def _climb(self, tree: int, known: dict[int, str], n: int, fetched: dict[tuple[int, int, int], str]) -> str:
        level = 0
        while n > 1:
            beside, above = {}, {}
            for run in dict.fromkeys(k // ARITY for k in known):
                first = ARITY * run
                children = [known[c] if c in known else fetched[tree, level, c] for c in range(first, min(first + ARITY, n))]
                above[run] = combined(children)
                for k in range(first, first + len(children)):
                    if k in known:
                        beside[k] = "".join(children[: k - first]), "".join(children[k - first + 1 :])
            self.beside.append(beside)
            known, n, level = above, -(-n // ARITY), level + 1
        return next(iter(known.values()))

    def _parent(self, at: int, k: int) -> int:
        """The index of a node's parent; a subroot's is found under its tree's number."""
        return self.tree if at + 1 == self.first_above else k // ARITY

    def siblings(self, k: int) -> str:
        """Hex digests of a leaf's siblings, level by level to the root."""
        return self.above.get(k if self.first_above else self.tree, "")

    def folded(self, k: int, leaf: str) -> str:
        """The root that a leaf gives with its siblings."""
        k = k if self.first_above else self.tree
        for at, beside in enumerate(self.beside):
            left, right = beside[k]
            leaf = sha256((left + leaf + right).encode("ascii")).hexdigest()
            k = self._parent(at, k)
        return leaf


def prove(docs: DataFrame, *, fields: Sequence[str] = FIELDS, digest: bool = False) -> DataFrame:
    """A row for each document: ``doc_id, source, leaf, subroot, root, proof, folded_root, verified``.

    ``proof`` has the hex digests of the leaf's siblings, level by level from its
    source's tree to the top; as a ``digest``, ``proof_sha256`` is the hash of these. ``folded_root`` is what the document as
    :func:`without_newlines` tampers with it gives. Columns besides doc_id, source and the ``fields`` don't matter.

    Leaves of a source ascend by doc_id (null first), those of one doc_id by their hash, equal rows as they come: their
    proofs differ, but are the same whatever their order. A null source is a source of its own. No documents give no rows.
    """
    session = docs.sparkSession
    folder = f"{shared_folder(session)}/merkle-{uuid.uuid4().hex}"
    column = {c: F.col(c) for c in fields}
    tampered = {**column, "text": without_newlines(F.col("doc_id"), F.col("text"))} if "text" in column else column
    leaves = docs.select("doc_id", "source", leaf_of([*column.values()]).alias("leaf"), leaf_of([*tampered.values()]).alias("shown"))
    # Equal rows are told apart by where they are written, so that ranges can part them.
    leaves.withColumn("serial", F.monotonically_increasing_id()).write.parquet(f"{folder}/rows")
    held, runs = _ordered(session.read.parquet(f"{folder}/rows"), ["source"], ["doc_id", "leaf", "serial"], f"{folder}/leaves")

    sources = runs.groupBy("source").agg(F.max("n").alias("size"))
    trees, tree_runs = _ordered(sources, [], ["source"], f"{folder}/trees")
    n_trees, most = trees.agg(F.count("*"), F.max("size")).first()
    trees = trees.join(tree_runs.select("_part", "_shift"), "_part").select(F.col("source").alias("_source"), (F.col("_at") + F.col("_shift")).alias("tree"))
    runs = runs.join(trees, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    runs = runs.select(F.col("source").alias("_source"), F.col("_part").alias("_of"), "_shift", "tree", "n")
    placed = held.join(runs, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_of")))
    placed = placed.withColumn("pos", F.col("_at") + F.col("_shift")).withColumn("block", F.expr(f"pos div {ARITY**HEIGHT}"))
    placed = placed.select("tree", "block", "pos", "leaf", "shown", "doc_id", "source", "n")
    placed.write.parquet(f"{folder}/placed")
    placed = session.read.parquet(f"{folder}/placed")

    _tops_and_needs(placed, n_trees).write.parquet(f"{folder}/blocks")
    blocks = session.read.parquet(f"{folder}/blocks")
    columns = ["tree", "level", "idx", "hash", "n"]
    nodes = _nodes_above(blocks.where("hash IS NOT NULL").select(columns), -(-(most or 0) // ARITY**HEIGHT), f"{folder}/nodes")
    roots = nodes[0].where("n = 1")
    for part in nodes[1:]:
        roots = roots.unionByName(part.where("n = 1"))
    subroots = roots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"), "hash", F.lit(n_trees).cast("long").alias("n"))
    nodes += _nodes_above(subroots, n_trees, f"{folder}/top")
    every = nodes[0]
    for part in nodes[1:]:
        every = every.unionByName(part)

    needs = blocks.where("hash IS NULL").select("tree", "level", "idx", "home_tree", "home_block")
    wanted = needs.groupBy("tree", "level", "idx").agg(F.count("*").alias("asked"))
    wanted = every.select(*(F.col(c).alias(f"_{c}") for c in ("tree", "level", "idx")), F.col("hash")).join(
        wanted, [F.col(f"_{c}") == F.col(c) for c in ("tree", "level", "idx")]
    )
    wanted = wanted.drop("tree", "level", "idx")
    fetched = join_dealt(needs, wanted, {c: f"_{c}" for c in ("tree", "level", "idx")}, "asked", F.xxhash64("home_tree", "home_block"))
    fetched = fetched.select(
        F.col("home_tree").alias("tree"), F.col("home_block").alias("block"), F.lit(0).alias("kind"), F.col("idx").alias("pos"), "hash",
        F.col("tree").alias("of"), F.col("level").cast("long").alias("n"),
    )
    own = placed.select("tree", "block", F.lit(1).alias("kind"), "pos", F.col("leaf").alias("hash"), F.lit(0).cast("long").alias("of"), "n", "shown", "doc_id", "source")
    proof = ("proof_sha256", pa.string()) if digest else ("proof", pa.list_(pa.string()))
    kind, top_level = docs.schema["doc_id"].dataType.simpleString(), _height(n_trees)

    def run(batches):
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema(
            [("doc_id", first.schema.field("doc_id").type), ("source", pa.string()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string())]
            + [proof, ("folded_root", pa.string()), ("verified", pa.bool_())]
        )

        def rows():
            for (tree, _), group in _grouped((b for part in ([first], batches) for b in part)):
                there, mine = {}, []
                for _, _, kind, pos, node, of, n, shown, doc_id, source in group:
                    if kind:
                        mine.append((pos, node.hex(), shown.hex(), doc_id, source))
                        size = n
                    else:
                        there[of, n, pos] = node.hex()
                block = _Block(tree, {m[0]: m[1] for m in mine}, size, n_trees, there)
                subroot, root = there[TOP, 0, tree], there[TOP, top_level, 0]
                for pos, leaf, shown, doc_id, source in mine:
                    text = block.siblings(pos)
                    own_proof = sha256(text.encode("ascii")).hexdigest() if digest else [text[k : k + 64] for k in range(0, len(text), 64)]
                    folded = block.folded(pos, shown)
                    yield doc_id, source, leaf, subroot, root, own_proof, folded, folded == root

        yield from _batches(rows(), schema)

    stream = _in_blocks(fetched.unionByName(own, allowMissingColumns=True), "kind", "pos")
    last = "proof_sha256 string" if digest else "proof array<string>"
    return stream.mapInArrow(run, f"doc_id {kind}, source string, leaf string, subroot string, root string, {last}, folded_root string, verified boolean")


#: The CRC of a short ASCII string, eight steps for each byte.
_CRC = """(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT)),
 lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))))"""

_LEAF = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in FIELDS)

ORACLE = f"""
WITH RECURSIVE shown AS (
    SELECT *, CASE WHEN {_CRC.format('doc_id::VARCHAR')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents
), hashed AS (
    SELECT doc_id, source, sha256({_LEAF}) AS leaf, sha256({_LEAF.replace('text', 'other')}) AS tampered FROM shown
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
        dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM hashed
), low(tree, level, idx, hash, n) AS (
    SELECT tree, 0, pos, leaf, n FROM leaves
    UNION ALL
    SELECT tree, level + 1, idx // 3, sha256(string_agg(hash, '' ORDER BY idx)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY tree, level, idx // 3, n
), high(tree, level, idx, hash, n) AS (
    SELECT -1, 0, tree, hash, (SELECT count(DISTINCT tree) FROM leaves) FROM low WHERE n = 1
    UNION ALL
    SELECT -1, level + 1, idx // 3, sha256(string_agg(hash, '' ORDER BY idx)), (n + 2) // 3 FROM high WHERE n > 1 GROUP BY level, idx // 3, n
), heights AS (
    SELECT tree, max(level) AS height FROM low GROUP BY tree
), nodes AS (
    SELECT tree, level, idx, hash FROM low WHERE n > 1 UNION ALL SELECT tree, level, idx, hash FROM high WHERE n > 1
), steps AS (
    SELECT l.tree AS leaf_tree, l.pos, k AS step,
        CASE WHEN k < h.height THEN l.tree ELSE -1 END AS tree,
        CASE WHEN k < h.height THEN k ELSE k - h.height END AS level,
        CASE WHEN k < h.height THEN l.pos // (3 ** k)::BIGINT ELSE l.tree // (3 ** (k - h.height))::BIGINT END AS idx
    FROM leaves l JOIN heights h USING (tree), (SELECT max(level) AS height FROM high) t, range(0, 80) r(k)
    WHERE k < h.height + t.height
), sides AS (
    SELECT s.leaf_tree, s.pos, s.step,
        coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (b.idx < s.idx), '') AS before,
        coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (b.idx > s.idx), '') AS after
    FROM steps s JOIN nodes b ON b.tree = s.tree AND b.level = s.level AND b.idx // 3 = s.idx // 3 GROUP BY s.leaf_tree, s.pos, s.step
), fold(tree, pos, step, hash) AS (
    SELECT tree, pos, 0::BIGINT, tampered FROM leaves
    UNION ALL
    SELECT f.tree, f.pos, f.step + 1, sha256(s.before || f.hash || s.after) FROM fold f JOIN sides s ON s.leaf_tree = f.tree AND s.pos = f.pos AND s.step = f.step
), folded AS (
    SELECT tree, pos, max_by(hash, step) AS folded_root FROM fold GROUP BY tree, pos
), proofs AS (
    SELECT leaf_tree AS tree, pos, string_agg(before || after, '' ORDER BY step) AS proof FROM sides GROUP BY leaf_tree, pos
), root AS (
    SELECT hash AS root FROM high WHERE n = 1
)
SELECT l.doc_id, l.leaf, b.hash AS subroot, root.root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.folded_root, f.folded_root = root.root AS verified
FROM leaves l JOIN folded f USING (tree, pos) LEFT JOIN proofs p USING (tree, pos) JOIN high b ON b.level = 0 AND b.idx = l.tree CROSS JOIN root
"""
