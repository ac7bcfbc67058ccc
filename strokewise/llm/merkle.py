"""A Merkle manifest of a dataset: one tree for each source, one over the sources' roots.

Rows become leaves (native hashes of their columns), sorted by range, so that
each range holds a run of each of its sources' leaves.  Counts for each source
and range give the run's place in the source.  A range builds the subtrees
that lie in it whole; the nodes left over at its ragged ends are dealt out by
their coordinate (tree, level, place), finished in blocks of bounded size, and
joined back to the ranges that asked for them.  The sources' roots are leaves
of one more tree, built the same way.

Nodes have up to ``ARITY`` children; a level's last node may have fewer, even
one.  Nulls in a column are hashed as such, null sources are a source of their
own before all others, null ids come first.  Rows with the same id are ordered
by their leaf; repeated rows are leaves each, interchangeable with each other.
An empty table has no tree and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _ranges
from ._tables import written

ARITY = 3
#: Leaves in a range, about: a task holds their proofs.
ROWS = 50_000
#: Levels between the nodes that a task of the upper levels starts from and the one it ends at.
BLOCK_LEVELS = 9

Hashes = list[bytes]


def leaf_hash(*values: Column) -> Column:
    """SHA-256 of the values, each after its length in bytes, or ``-`` for null."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


def parent(children: Hashes) -> bytes:
    """Hash of the children's digests, as hexadecimal text."""
    return hashlib.sha256(b"".join(children)).hexdigest().encode()


def above(n: int) -> int:
    """Nodes one level up."""
    return -(-n // ARITY)


def levels(n: int) -> int:
    """Levels from the leaves to the single node of a tree."""
    out = 0
    while n > 1:
        n, out = above(n), out + 1
    return out


class Run:
    """The part of a tree that follows from leaves start .. start+len(leaves) of total."""

    def __init__(self, leaves: Hashes, start: int, total: int):
        self.start, self.end, self.total = start, start + len(leaves), total
        self.known: list[tuple[int, Hashes]] = [(start, leaves)]  # for each level the first place, and nodes from there
        self.sizes = [total]
        while self.sizes[-1] > 1:
            self.sizes.append(above(self.sizes[-1]))
        for level, n in enumerate(self.sizes[:-1]):
            first, nodes = self.known[level]
            left, right = -(-first // ARITY), (first + len(nodes)) // ARITY if first + len(nodes) < n else above(n)
            made = [parent(nodes[max(0, ARITY * p - first) : ARITY * (p + 1) - first]) for p in range(left, right)]
            self.known.append((left, made))

    @property
    def top(self) -> bytes | None:
        nodes = self.known[-1][1]
        return nodes[0] if nodes else None

    def ragged(self) -> Iterator[tuple[int, int, bytes]]:
        """(level, place, hash) of known nodes whose parent isn't known."""
        for level in range(len(self.sizes) - 1):
            first, nodes = self.known[level]
            left, made = self.known[level + 1]
            for i, h in enumerate(nodes):
                if not left <= (first + i) // ARITY < left + len(made):
                    yield level, first + i, h

    def asks(self) -> Iterator[tuple[int, int]]:
        """(level, place) of unknown nodes that stand beside a path from these leaves, and of the unknown top."""
        for level, n in enumerate(self.sizes[:-1]):
            first, nodes = self.known[level]
            step = ARITY ** (level + 1)
            for i in range(ARITY * (self.start // step), min(n, ARITY * ((self.end - 1) // step + 1))):
                if not first <= i < first + len(nodes):
                    yield level, i
        if self.top is None:
            yield len(self.sizes) - 1, 0

    def proofs(self, given: dict[tuple[int, int], bytes], rest: list[dict]) -> pa.Array:
        """The siblings before and after each leaf's path, level by level, then those of the rest, which all share."""
        pool: list[bytes] = [b""]
        place, rows = np.arange(self.start, self.end), self.end - self.start
        beside = np.zeros((rows, len(self.sizes) - 1 + len(rest), 2, ARITY), np.int64)  # places in the pool; 0: none
        for level, n in enumerate(self.sizes[:-1]):
            first, nodes = self.known[level]
            low = place - place % ARITY
            start, names = int(low[0]), range(int(low[0]), min(n, int(low[-1]) + ARITY))
            pooled = len(pool) - start
            pool += [nodes[i - first] if first <= i < first + len(nodes) else given[level, i] for i in names]
            for k in range(ARITY):
                side = low + k
                for later in (0, 1):
                    on = (side < n) & ((side > place) if later else (side < place))
                    beside[on, level, later, k] = (side + pooled)[on]
            place = place // ARITY
        for i, r in enumerate(rest, len(self.sizes) - 1):
            for later, hashes in enumerate((r["before"], r["after"])):
                for k, h in enumerate(hashes):
                    beside[:, i, later, k] = len(pool)
                    pool.append(h.encode())
        names = pa.array([h.decode() for h in pool], pa.string())
        sides = []
        for later in (0, 1):
            part = beside[:, :, later].reshape(-1, ARITY)
            ends = np.concatenate([[0], np.cumsum((part > 0).sum(1))])
            sides.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(part[part > 0]))))
        return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * beside.shape[1], pa.int32()), pa.StructArray.from_arrays(sides, names=["before", "after"]))


PROOF = "array<struct<before:array<string>,after:array<string>>>"
_PROOF = pa.list_(pa.struct([("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))]))

_EDGE = pa.schema([("kind", pa.int32()), ("tree", pa.int64()), ("range", pa.int64()), ("total", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("hash", pa.string())])
_NODE = pa.schema([("tree", pa.int64()), ("total", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("hash", pa.string()), ("top", pa.bool_())])
#: Kinds of edges: a node without its parent, a node asked for, the top of a tree in one range (its place is where it begins).
RAGGED, ASKED, WHOLE = 0, 1, 2


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _runs(leaves: pa.Table, counts: pa.Table) -> Iterator[tuple[dict, Run]]:
    """Each tree's run in a range, in the order of its (sorted) leaves."""
    hashes = [h.encode() for h in leaves.column("leaf").to_pylist()]
    for c in sorted(counts.to_pylist(), key=lambda c: c["least"]):
        yield c, Run(hashes[c["least"] : c["least"] + c["n"]], c["before"], c["total"])


def _edges(leaves: pa.Table, counts: pa.Table) -> pa.Table:
    rows: list[tuple] = []
    for c, run in _runs(leaves.sort_by("at"), counts):
        if c["n"] < c["total"]:
            who = (c["home"], c["range"], c["total"])
            rows += [(RAGGED, *who, level, i, h.decode()) for level, i, h in run.ragged()]
            rows += [(ASKED, *who, level, i, None) for level, i in run.asks()]
        else:
            rows.append((WHOLE, c["home"], c["range"], c["total"], 0, c["least"], run.top.decode()))
    return _table(rows, _EDGE)


def _block(height: int):
    def finish(nodes: pa.Table) -> pa.Table:
        """All nodes above these up to the height (a level), of one tree below one node there."""
        given = nodes.select(["tree", "total", "level", "place", "hash"]).to_pylist()
        tree, total = given[0]["tree"], given[0]["total"]
        here: dict[int, dict[int, bytes]] = {}
        for r in given:
            here.setdefault(r["level"], {})[r["place"]] = r["hash"].encode()
        rows, level, n = [], min(here), total
        for _ in range(level):
            n = above(n)
        while level < height and n > 1:
            for p in sorted({i // ARITY for i in here.get(level, ())}):
                h = parent([here[level][i] for i in range(ARITY * p, min(n, ARITY * (p + 1)))])
                here.setdefault(level + 1, {})[p] = h
                rows.append((tree, total, level + 1, p, h.decode(), above(n) == 1))
            level, n = level + 1, above(n)
        return _table(rows, _NODE)

    return finish


def _upper(edges: DataFrame, largest: int, most: int) -> list[DataFrame]:
    """Tables of the nodes above the ragged ones, block of levels by block of levels.

    largest: a tree's leaves at most; most: a range's.  A task holds what lies
    below one node: the ragged nodes of about ARITY**BLOCK_LEVELS ranges, then as many nodes.
    """
    low, height, made = 0, levels(most) + BLOCK_LEVELS, []
    columns = ["tree", "total", "level", "place", "hash"]
    ragged = edges.where(F.col("kind") == RAGGED).select(*columns)
    while True:
        live = ragged.where((F.col("level") >= low) & (F.col("level") < height))
        if made:
            live = live.union(made[-1].where(F.col("level") == low).select(*columns))
        block = F.expr(f"place div cast(pow({ARITY}, {height} - level) as bigint)")
        made.append(written(live.withColumn("block", block).groupBy("tree", "block").applyInArrow(_block(height), _ddl(_NODE)), "nodes"))
        if height >= levels(largest):
            return made
        low, height = height, height + BLOCK_LEVELS


def _proved(leaves: pa.Table, about: pa.Table) -> pa.Table:
    """The range's rows with their place, proof, their tree's top and the root."""
    leaves = leaves.sort_by("at")
    counts, given = (about.filter(pa.array(about.column("asked").to_numpy(zero_copy_only=False) == k)) for k in (False, True))
    have: dict[int, dict[tuple[int, int], bytes]] = {}
    for r in given.select(["home", "level", "before", "hash"]).to_pylist():
        have.setdefault(r["home"], {})[r["level"], r["before"]] = r["hash"].encode()
    places, tops, roots, proofs = [], [], [], []
    for c, run in _runs(leaves, counts):
        mine = have.get(c["home"], {}) if c["n"] < c["total"] else {}
        top = (run.top or mine[len(run.sizes) - 1, 0]).decode()
        places.append(np.arange(run.start, run.end))
        tops += [top] * c["n"]
        roots += [c["root"] or top] * c["n"]
        proofs.append(run.proofs(mine, c["rest"] or []))
    keep = [n for n in leaves.column_names if n not in ("range", "at")]
    cols = [pa.array(np.concatenate(places)), pa.array(tops, pa.string()), pa.array(roots, pa.string()), pa.chunked_array(proofs, _PROOF)]
    return pa.Table.from_arrays([*[leaves.column(n) for n in keep], *cols], names=[*keep, "place", "top", "root", "proof"])


def proved(table: DataFrame, group: str, order: list[Column], over: bool) -> DataFrame:
    """A written table's rows (with a column ``leaf``) with place, top, root and proof.

    Each group is a tree, its leaves in the given order, which must tell rows
    with different leaves apart.  over: the groups' tops, in the groups' order,
    are the leaves of one more tree; otherwise a tree's top is its root.
    """
    spark = table.sparkSession
    leaves, counts = _ranges.placed(table, [group], order, "leaves", ROWS)
    counts = written(counts, "counts")
    sizes = counts.agg(F.max("total"), F.max("n"), F.count_if(F.col("n") < F.col("total"))).first()
    few = counts.select("range", "least", "n", "before", "total", "home")
    edges = written(leaves.select("range", "at", "leaf").groupBy("range").cogroup(few.groupBy("range")).applyInArrow(_edges, _ddl(_EDGE)), "edges")
    made = _upper(edges, sizes[0], sizes[1]) if sizes[2] else [spark.createDataFrame([], _ddl(_NODE))]
    nodes = edges.where(F.col("kind") == RAGGED).select("tree", "level", "place", "hash")
    for m in made:
        nodes = nodes.union(m.select("tree", "level", "place", "hash"))
    asked = edges.where(F.col("kind") == ASKED).select("range", "tree", "level", "place")
    given = written(asked.join(nodes, ["tree", "level", "place"]).select("range", "tree", "level", "place", "hash"), "given")
    context = counts.withColumn("root", F.lit(None).cast("string")).withColumn("rest", F.lit(None).cast(PROOF))
    if over:
        tops = edges.where(F.col("kind") == WHOLE).select("range", F.col("place").alias("least"), F.col("hash").alias("leaf")).join(counts.select("range", "least", group), ["range", "least"]).select(group, "leaf")
        for m in made:
            tops = tops.union(m.where("top").select(F.col("tree").alias("range"), F.col("hash").alias("leaf")).join(counts.where("before = 0 and n < total").select("range", group), "range").select(group, "leaf"))
        upper = proved(written(tops.withColumn("all", F.lit(0)), "tops"), "all", [F.asc_nulls_first(group)], over=False)
        upper = written(upper.select(F.col(group).alias("named"), "root", F.col("proof").alias("rest")), "upper")
        context = counts.join(upper, F.col(group).eqNullSafe(F.col("named")))
    none = {"least": "long", "n": "long", "total": "long", "root": "string", "rest": PROOF}
    asks = given.select("range", F.lit(True).alias("asked"), F.col("tree").alias("home"), F.col("place").alias("before"), "level", "hash", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    about = context.select("range", F.lit(False).alias("asked"), "home", "before", F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("hash"), *none).unionByName(asks)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    return leaves.groupBy("range").cogroup(about.groupBy("range")).applyInArrow(_proved, f"{shape}, place long, top string, root string, proof {PROOF}")


def manifest(docs: DataFrame, doc: str = "doc_id", group: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), also: dict[str, Column] | None = None) -> DataFrame:
    """doc, group, leaf, place (in its group), subroot, root and proof (siblings from leaf to root) of each row; more columns by name.

    Other columns of the documents are left out; columns that are asked for are computed where the leaves are hashed.
    """
    also = also or {}
    leaf = leaf_hash(*[F.col(c) for c in columns])
    tie = F.monotonically_increasing_id()  # so that no number of equal rows fills a range
    base = written(docs.select(F.col(doc).alias("d"), F.col(group).cast("string").alias("g"), leaf.alias("leaf"), *[v.alias(f"also_{n}") for n, v in also.items()]).withColumn("tie", tie), "base")
    out = proved(base, "g", [F.asc_nulls_first("d"), F.asc("leaf"), F.asc("tie")], over=True)
    return out.select(F.col("d").alias(doc), F.col("g").alias(group), "leaf", "place", F.col("top").alias("subroot"), "root", "proof", *[F.col(f"also_{n}").alias(n) for n in also])


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and a proof."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(F.array_join(s["before"], ""), h, F.array_join(s["after"], "")), 256))


def proof_hash(proof: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.array_join(F.concat(s["before"], s["after"]), "")), ""), 256)


def digest(docs: DataFrame) -> DataFrame:
    """The manifest, and what becomes of it when every second id's text loses its newlines."""
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    tampered = leaf_hash(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
    out = manifest(docs, also={"tampered": tampered})
    out = out.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("proof")).alias("proof_sha256"), folded(F.col("tampered"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
