"""Merkle manifest of a table: an associative sparse-forest monoid, reduced as a tree.

Every group of rows (a source) is a tree of arity 16 over its rows in key order, and the
groups' roots are the leaves of one more tree above them. A `Forest` holds the nodes of some
rows that no parent has swallowed yet, keyed by (tree, level, index). Merging two forests is
a union after which each sibling run that is complete becomes its parent; how many siblings a
run has is known from the tree's number of leaves. Union of keyed nodes is associative and
commutative, so forests may be merged in any grouping.

Rows are dealt to parts by range, so a part holds at most two trees that go on outside it, and
its forest has at most 15 open nodes at either end of each level: a few hundred, whatever the
table's size. Forests are merged sixteen parts at a time, round by round (a treeReduce whose
rounds are written tables, so that the runs completed on the way, which proofs need, stay in
tables too and never meet in the driver). Then every part gets those runs that its own rows
have above them, and builds the proofs.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcatlas import ship
from srcatlas.llm._store import discard, materialize

ARITY = 16
BITS = 4
#: Rows of a part, about: what one task holds of the digests.
PART_ROWS = 100_000
#: Forests merged at once in a round, as a power of two.
FAN_BITS = 4
#: The tree above the groups.
TOP = -1
HEX = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OPEN = "part long, kind string, tree long, n long, trees long, level int, index long, digest string"


def digest(inputs: Iterable[str]) -> str:
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def width(n: int, level: int) -> int:
    """Nodes of a level of a tree of n leaves."""
    return -(-n >> BITS * level) if n else 0


def depth(n: int) -> int:
    """The level of the root."""
    level = 0
    while width(n, level) > 1:
        level += 1
    return level


def arity(n: int, level: int, run: int) -> int:
    """Siblings in a run of a level."""
    return min(ARITY, width(n, level) - run * ARITY)


class Forest:
    """Open nodes by (tree, level, index), the trees' numbers of leaves, and the runs that were completed here."""

    def __init__(self, trees: int) -> None:
        self.sizes: dict[int, int] = {TOP: trees}
        self.nodes: dict[tuple[int, int, int], str] = {}
        self.runs: dict[tuple[int, int, int], list[str]] = {}
        self.roots: dict[int, str] = {}

    def add(self, tree: int, n: int, level: int, index: int, value: str) -> None:
        self.sizes[tree] = n
        self.nodes[tree, level, index] = value

    def merge(self, other: Forest) -> Forest:
        """The union, with complete runs resolved."""
        self.sizes |= other.sizes
        self.nodes |= other.nodes
        self.runs |= other.runs
        self.roots |= other.roots
        return self.settle()

    def settle(self) -> Forest:
        """Every complete run becomes its parent; a tree's root becomes a leaf of the tree above."""
        fresh = list(self.nodes)
        while fresh:
            held: dict[tuple[int, int, int], int] = defaultdict(int)
            for tree, level, index in fresh:
                held[tree, level, index >> BITS] = 0
            for tree, level, index in self.nodes:
                if (run := (tree, level, index >> BITS)) in held:
                    held[run] += 1
            fresh = []
            for (tree, level, run), count in held.items():
                n = self.sizes[tree]
                if width(n, level) == 1:
                    if tree != TOP:
                        self.roots[tree] = value = self.nodes.pop((tree, level, 0))
                        self.nodes[TOP, 0, tree] = value
                        fresh.append((TOP, 0, tree))
                elif count == arity(n, level, run):
                    children = [self.nodes.pop((tree, level, run * ARITY + i)) for i in range(count)]
                    self.runs[tree, level, run] = children
                    self.nodes[tree, level + 1, run] = digest(children)
                    fresh.append((tree, level + 1, run))
        return self

    def above(self) -> set[tuple[int, int, int]]:
        """The runs that hold the open nodes and all that will stand above them."""
        out: set[tuple[int, int, int]] = set()
        for tree, level, index in self.nodes:
            top = depth(self.sizes[tree])
            while level < top and (run := (tree, level, index >> BITS)) not in out:
                out.add(run)
                level, index = level + 1, index >> BITS
            if tree != TOP and level == top:
                level, index = 0, tree
                while level < depth(self.sizes[TOP]):
                    out.add((TOP, level, index >> BITS))
                    level, index = level + 1, index >> BITS
        return out


class Prover:
    """Proofs from runs: each node's siblings and those of all nodes above it, once for each node."""

    def __init__(self, sizes: dict[int, int], runs: dict[tuple[int, int, int], list[str]]) -> None:
        self.sizes, self.runs, self.known = sizes, runs, {}

    def proof(self, tree: int, level: int, index: int) -> tuple[tuple[int, str], ...]:
        """(place, the run's others as one string) for each level up to the root."""
        key = tree, level, index
        out = self.known.get(key)
        if out is None:
            if level == depth(self.sizes[tree]):
                out = () if tree == TOP else self.proof(TOP, 0, tree)
            else:
                children, place = self.runs[tree, level, index >> BITS], index & ARITY - 1
                out = ((place, "".join(children[:place] + children[place + 1 :])), *self.proof(tree, level + 1, index >> BITS))
            if level or tree == TOP:  # a leaf is asked for once
                self.known[key] = out
        return out

    def root(self, tree: int, only: str) -> str:
        """A tree's root; `only` is the leaf of a tree that has no other."""
        top = depth(self.sizes[tree])
        return only if not top else digest(self.runs[tree, top - 1, 0])


def encoded(*columns: Column) -> Column:
    """Values as one string from which they can be read back: `-` for null, else byte count, colon, value."""
    return F.concat(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in (c.cast("string") for c in columns)))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, leaf, lambda h, p: F.sha2(F.concat(F.substring(p["siblings"], F.lit(1), p["place"] * HEX), h, F.substring(p["siblings"], p["place"] * HEX + 1, F.lit(ARITY * HEX))), 256))


def _parts(leaves: DataFrame) -> DataFrame:
    """Leaves dealt to parts by (group, key), in order: adds part and at. Rows of one key are ordered by their leaf."""
    spark = leaves.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // PART_ROWS))
    order = ["__group", "__key", "leaf", "__tie"]  # the last one lets equal rows be cut apart
    dealt = leaves.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("__tie")
    return dealt.withColumn("__row", F.monotonically_increasing_id()).withColumns({"part": F.shiftright("__row", 33), "at": F.col("__row").bitwiseAND((1 << 33) - 1)}).drop("__row")


def _places(rows: DataFrame) -> DataFrame:
    """For each part and tree in it: the tree's number and size, where it begins in the part, and the leaf's index there. Windows run over the parts of a tree, the trees of a part, or the parts."""
    found = rows.groupBy("part", "__group").agg(F.count(F.lit(1)).alias("here"), F.min("at").alias("begin"))
    tree = Window.partitionBy("__group")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumns({"n": F.sum("here").over(tree), "offset": F.coalesce(F.sum("here").over(before), F.lit(0)), "first": F.min("part").over(tree)})
    found = materialize(found, "merkle-places")
    begun = found.groupBy("part").agg(F.sum((F.col("first") == F.col("part")).cast("long")).alias("begun"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    numbers = begun.select(F.col("part").alias("__part"), F.coalesce(F.sum("begun").over(over), F.lit(0)).alias("base"))
    total = begun.agg(F.coalesce(F.sum("begun"), F.lit(0)).alias("trees"))
    # A tree's number: those begun in earlier parts, and its place among those begun in its first.
    own = found.filter(F.col("first") == F.col("part")).withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("__group")) - 1)
    named = own.join(numbers, own["part"] == numbers["__part"]).select(F.col("__group").alias("__g"), (F.col("base") + F.col("place")).alias("tree"))
    placed = found.join(named, F.col("__group") == F.col("__g")).crossJoin(F.broadcast(total))  # one row
    out = materialize(placed.select("part", "tree", "n", "offset", "begin", "here", "trees"), "merkle-trees")
    discard(found)
    return out


def _help(rows: DataFrame, kind: str, at: Column, level: Column, index: Column, value: Column) -> DataFrame:
    """Rows that a part gets beside its leaves."""
    return rows.select("part", F.lit(kind).alias("kind"), at.cast("long").alias("at"), "tree", "n", "trees", level.alias("level"), index.alias("index"), value.cast("string").alias("digest"))


def _sides(t: pa.Table) -> tuple[pa.Table, list[dict], list[dict]]:
    """A part's leaves in order, its trees in order, and the runs from outside."""
    kind = t["kind"].to_pylist()
    pick = lambda k: t.take(pa.array([i for i, x in enumerate(kind) if x == k], pa.int64()))
    light = ["at", "tree", "n", "trees", "level", "index", "digest"]
    trees = sorted(pick("tree").select(light).to_pylist(), key=lambda r: r["at"])
    return pick("leaf").sort_by("at"), trees, pick("run").select(light).to_pylist()


def _grown(leaves: pa.Table, trees: list[dict]) -> tuple[Forest, list[tuple[int, int]]]:
    """The forest of a part's leaves, and each leaf's (tree, index)."""
    forest, spots = Forest(trees[0]["trees"]), []
    values = leaves["digest"].to_pylist()
    ends = [t["at"] for t in trees[1:]] + [len(values)]
    for t, end in zip(trees, ends, strict=True):
        for at in range(t["at"], end):
            index = t["index"] + at - t["at"]
            forest.add(t["tree"], t["n"], 0, index, values[at])
            spots.append((t["tree"], index))
    return forest.settle(), spots


def _row(part: int, kind: str, forest: Forest, tree: int, level: int, index: int, value: str | None) -> tuple:
    return part, kind, tree, forest.sizes[tree], forest.sizes[TOP], level, index, value


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("part", pa.int64()), ("kind", pa.string()), ("tree", pa.int64()), ("n", pa.int64()), ("trees", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string())]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's open nodes, and the runs from outside that it will need."""
    t = pa.Table.from_batches(list(batches))
    part = t["part"][0].as_py()
    leaves, trees, _ = _sides(t)
    forest, _ = _grown(leaves, trees)
    out = [_row(part, "node", forest, *key, value) for key, value in forest.nodes.items()]
    yield _batch(out + [_row(part, "need", forest, *key, None) for key in forest.above()])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of neighbouring parts become one: its open nodes, and the runs that were completed now."""
    forest, part = None, 0
    for r in (x for b in batches for x in b.to_pylist()):
        part = r["part"] >> FAN_BITS
        forest = forest or Forest(r["trees"])
        forest.add(r["tree"], r["n"], r["level"], r["index"], r["digest"])
    forest.settle()
    out = [_row(part, "node", forest, *key, value) for key, value in forest.nodes.items()]
    yield _batch(out + [_row(part, "run", forest, *key, "".join(children)) for key, children in forest.runs.items()])


def _reduced(opened: DataFrame, parts: int) -> list[DataFrame]:
    """Rounds of merges up to one forest; tables of the rounds, with the runs completed in each."""
    rounds, left = [opened], parts
    while True:
        nodes = rounds[-1].filter(F.col("kind") == "node").drop("kind")
        grouped = nodes.withColumn("__to", F.shiftright("part", FAN_BITS)).groupBy("__to")
        rounds.append(materialize(grouped.applyInArrow(_merged, OPEN), "merkle-merged"))
        left = -(-left >> FAN_BITS)
        if left <= 1:
            return rounds[1:]


def manifest(leaves: DataFrame, group_col: str, key_col: str, leaf_col: str, keep: Iterable[str] = ()) -> DataFrame:
    """Proofs of all rows: group, key, leaf, subroot, root, proof array<struct<place int, siblings string>>, and the columns of `keep`.

    Groups are ordered with null first, then by the bytes of their name; rows of a group by
    key, null first, and rows of one key by leaf. Repeated rows are leaves of their own. Proofs
    begin at the leaf's siblings; a place says how many of them stand before it, and siblings
    are the hex digests without separators. An empty table gives an empty result. Columns that
    are not named are not read.
    """
    spark, keep = leaves.sparkSession, list(keep)
    ship.ensure(spark)
    named = leaves.select(F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit("")).alias("__group"), F.col(key_col).alias("__key"), F.col(leaf_col).alias("leaf"), *(F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)))
    own = ["__group", "__key", *(f"__keep_{i}" for i in range(len(keep)))]
    rows = materialize(_parts(named), "merkle-leaves")
    places = _places(rows)
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    leaf = rows.select("part", F.lit("leaf").alias("kind"), "at", *(F.lit(None).cast(k).alias(c) for c, k in (("tree", "long"), ("n", "long"), ("trees", "long"), ("level", "int"), ("index", "long"))), F.col("leaf").alias("digest"), *own)
    trees = _help(places, "tree", F.col("begin"), F.lit(0), F.col("offset"), F.lit(None))
    slim = leaf.drop(*own).unionByName(trees)
    opened = materialize(slim.groupBy("part").applyInArrow(_open, OPEN), "merkle-open")
    rounds = _reduced(opened, parts)
    runs = rounds[0]
    for r in rounds[1:]:
        runs = runs.unionByName(r)
    runs = runs.filter(F.col("kind") == "run").drop("part")
    needs = opened.filter(F.col("kind") == "need").select("part", *(F.col(c).alias(f"__{c}") for c in ("tree", "level", "index")))
    answers = needs.join(runs, (F.col("tree") == F.col("__tree")) & (F.col("level") == F.col("__level")) & (F.col("index") == F.col("__index")))
    answers = materialize(_help(answers, "run", F.lit(-1), F.col("level"), F.col("index"), F.col("digest")), "merkle-runs")
    discard(opened, *rounds)
    every = leaf.unionByName(trees, allowMissingColumns=True).unionByName(answers, allowMissingColumns=True)
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in own), "leaf string, subroot string, root string, proof array<struct<place: int, siblings: string>>"])

    def proven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, trees, outside = _sides(pa.Table.from_batches(list(batches)))
        forest, spots = _grown(leaves, trees)
        for r in outside:
            forest.sizes[r["tree"]] = r["n"]
            forest.runs[r["tree"], r["level"], r["index"]] = [r["digest"][i : i + HEX] for i in range(0, len(r["digest"]), HEX)]
        prover = Prover(forest.sizes, forest.runs)
        root, subroots = None, {}
        for lo in range(0, len(spots), 1000):
            part = leaves.slice(lo, 1000).combine_chunks()
            values = part["digest"].to_pylist()
            roots, at, places, siblings = [], [0], [], []
            for (tree, index), value in zip(spots[lo : lo + 1000], values, strict=True):
                if tree not in subroots:
                    subroots[tree] = prover.root(tree, value)
                root = root or prover.root(TOP, subroots[tree])
                roots.append(subroots[tree])
                for place, others in prover.proof(tree, 0, index):
                    places.append(place)
                    siblings.append(others)
                at.append(len(places))
            steps = pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(siblings, pa.string())], ["place", "siblings"])
            proof = pa.ListArray.from_arrays(pa.array(at, pa.int32()), steps)
            carried = [part[c].combine_chunks() if part[c].num_chunks != 1 else part[c].chunk(0) for c in own]
            yield pa.RecordBatch.from_arrays([*carried, pa.array(values, pa.string()), pa.array(roots, pa.string()), pa.array([root] * len(values), pa.string()), proof], [*own, "leaf", "subroot", "root", "proof"])

    done = every.groupBy("part").applyInArrow(proven, schema)
    group = F.when(F.col("__group") != "", F.substring("__group", 2, 1 << 30))
    return done.select(group.alias(group_col), F.col("__key").alias(key_col), "leaf", "subroot", "root", "proof", *(F.col(f"__keep_{i}").alias(c) for i, c in enumerate(keep)))


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, source, the row's leaf, and the leaf of its tampered form (A-Z of the text in lower case) where 5 divides crc32(doc_id), else null."""
    own = [F.col(c) for c in COLUMNS]
    tampered = [*own[:-1], F.translate("text", UPPER, LOWER)]
    chosen = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    return docs.select("doc_id", "source", F.sha2(encoded(*own), 256).alias("leaf"), F.when(chosen, F.sha2(encoded(*tampered), 256)).alias("suspect"))


def query(spark, sf_dir):
    from srcatlas.llm._store import table

    leaves = materialize(hashed(table(spark, sf_dir, "documents")), "merkle-hashed")  # texts are read once
    proven = manifest(leaves, "source", "doc_id", "leaf", ["suspect"])
    siblings = F.array_join(F.transform("proof", lambda p: p["siblings"]), "")
    out = proven.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("suspect", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, *, CAST(doc_id AS VARCHAR) AS id, CAST(n_chars AS VARCHAR) AS nc FROM documents),
e AS (SELECT rid, doc_id, source, coalesce(strlen(id) || ':' || id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(nc) || ':' || nc, '-') AS head,
  coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(text) || ':' || translate(text, '{UPPER}', '{LOWER}'), '-') AS tampered,
  xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(id, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) AS crc FROM d),
l AS (SELECT rid, doc_id, source, sha256(head || body) AS leaf, sha256(head || CASE WHEN crc % 5 = 0 THEN tampered ELSE body END) AS suspect FROM e),
s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER () AS trees FROM (SELECT DISTINCT source FROM l)),
p AS (SELECT l.*, s.tree, s.trees, row_number() OVER (PARTITION BY s.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY s.tree) AS n FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source),
nodes AS (SELECT tree, 0 AS level, i, n, leaf AS h FROM p
  UNION ALL SELECT tree, level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, level, i // 16, n),
tops AS (SELECT 0 AS level, nodes.tree AS i, s.trees AS n, h FROM nodes JOIN s USING (tree) WHERE nodes.n = 1
  UNION ALL SELECT level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 16, n),
runs AS (SELECT tree, level, i // 16 AS run, list(h ORDER BY i) AS hs FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT -1, level, i // 16, list(h ORDER BY i) FROM tops WHERE n > 1 GROUP BY level, i // 16),
w AS (SELECT rid, tree AS own, tree, 0 AS level, i, n, '' AS proof, suspect AS h, trees FROM p
  UNION ALL SELECT w.rid, own, w.tree, w.level + 1, i // 16, (n + 15) // 16, proof || array_to_string(hs[:i % 16], '') || array_to_string(hs[i % 16 + 2:], ''), sha256(array_to_string(hs[:i % 16], '') || h || array_to_string(hs[i % 16 + 2:], '')), trees
  FROM w JOIN runs ON runs.tree = w.tree AND runs.level = w.level AND runs.run = w.i // 16 WHERE n > 1),
v AS (SELECT rid, 0 AS level, own AS i, trees AS n, proof, h FROM w WHERE n = 1
  UNION ALL SELECT v.rid, v.level + 1, i // 16, (n + 15) // 16, proof || array_to_string(hs[:i % 16], '') || array_to_string(hs[i % 16 + 2:], ''), sha256(array_to_string(hs[:i % 16], '') || h || array_to_string(hs[i % 16 + 2:], ''))
  FROM v JOIN runs ON runs.tree = -1 AND runs.level = v.level AND runs.run = v.i // 16 WHERE n > 1),
r AS (SELECT h AS root FROM tops WHERE n = 1)
SELECT p.doc_id, p.leaf, b.h AS subroot, r.root, sha256(v.proof) AS proof_sha256, v.h AS folded_root, v.h = r.root AS verified
FROM p JOIN nodes b ON b.tree = p.tree AND b.n = 1 JOIN v ON v.rid = p.rid AND v.n = 1 CROSS JOIN r
"""
