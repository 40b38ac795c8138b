"""MinHash near-dedup: a chosen-path set similarity join, and the components of its links.

A document's set holds its distinct shingles of five words, A-Z lower-cased; fewer words
are one shingle.  Two documents are linked if 100 * intersection >= 75 * union.

Equal sets are one vertex.  The others get `MINHASHES` minwise tokens; the first of them, whole, lead into the trees, and eight bits of
each make up the signature.  Each of `TREES` independent
trees branches the vertices by a chosen minwise token of its own.  A node of at most `NODE` vertices is
compared exhaustively.  A larger one is settled first: it is dealt at random into small blocks, whose likely pairs are
confirmed on the full sets, and the components found so far become labels.  A node with one label, as a group of near
copies mostly is, holds nothing more to find.  If at most `OUTSIDE` of its vertices lie outside its main component these are compared with
the whole node, which is linear in its size.  Else it is branched: by `BRANCHES` further tokens, and each of these paths by one token more, or two
for every third path, until every node is of one of these kinds; there is no last depth.  Every step of every path has a token
of its own, drawn from the full sets.

Two documents at 0.75 agree in a token with probability 0.75, so sixteen trees miss one of 4e9 such
pairs if their nodes are small.  A branched path goes on as 4/3 paths on average: a pair at 0.75 keeps one of them on average,
and trees miss one of 7e5 if all nodes are branched eight steps deep, one of 5e3 at sixteen steps.  Documents that are less alike
thin out at every step, so the rows of a level fall, and the sizes of its nodes with them.

Comparing inside a small node is by signatures and gives a spanning forest of the pairs that
could be links, the likeliest first; a forest edge is then confirmed on the full sets.  If all
edges of a node hold, its other pairs can't change the components.  Nodes with
a refuted edge, and the ends of branching, are compared for all pairs whose labels differ, in cells of bounded numbers of vertices and
shingles: by signatures first, and those that have a likely partner by products of incidence matrices over the full sets.

Null texts are empty; documents without words have no shingles and no links.  Rows without an id are left out; rows that repeat an
id are linked like others and named by it.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.graph import components, sized
from llm.tables import texts
from llm.words import Words, mix, runs, slices, words
from pagescan.operators.prune import among
from pagescan.storage import Workspace

SHINGLE = 5
PERCENT = 75
TREES = 16
BRANCHES = 4
MINHASHES = 160
NODE = 48
BLOCK = 24
OUTSIDE = 1024
CHUNK, PART = 512, 2048  # vertices of a cell: outside the main component, and of the node
CELL = 2_000_000  # shingles of a cell, about
SLICE = 1 << 20  # bytes of text whose shingles are hashed at a time
# Pairs whose signatures agree in fewer places are no links: of pairs at 0.75, one of 5.4 million agrees in fewer; of pairs at 0.45 one of 500 agrees in as many.
AGREE = 91
# Settling a large node tries pairs that agree as often as links do.
LIKELY = 120
_SET_BYTES = 6


def shingles(found: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all rows, row by row, and the rows + 1 offsets into them."""
    hashes, count = found.hashes(), np.diff(found.first)
    grams = runs(hashes, size)
    whole = found.starts_of(size)[: len(grams)]
    row = found.row
    rows, values = row[: len(grams)][whole], grams[whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        single = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            has = count[short] > j
            single[has] = mix(single[has], hashes[found.first[short[has]] + j])
        rows, values = np.concatenate([rows, short]), np.concatenate([values, mix(single, count[short].astype(np.uint64))])
    # Sorted by row and the upper 48 bits; rows of a slice are fewer than 2 ** 16.
    order = np.argsort((rows.astype(np.uint64) << np.uint64(48)) | (values >> np.uint64(16)))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    rows, values = rows[new], values[new]
    return values, np.searchsorted(rows, np.arange(len(count) + 1))


def signatures(values: np.ndarray, offsets: np.ndarray, count: int = MINHASHES) -> np.ndarray:
    """Rows x count minwise tokens; rows without shingles get zeros."""
    random = np.random.default_rng(5)
    factors, masks = random.integers(0, 1 << 63, (count, 2), dtype=np.uint64).T
    factors = factors * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(offsets) - 1, count), np.uint32)
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        for j in range(count):
            out[filled, j] = np.minimum.reduceat(((values ^ masks[j]) * factors[j]) >> np.uint64(32), offsets[filled])
    return out


def _row_slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for piece in slices(batch, "text", SLICE):
        for at in range(0, piece.num_rows, 1 << 16):
            part = piece.slice(at, 1 << 16)
            yield part, words(part.column("text"), lower=True)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, found in _row_slices(batch):
            values, offsets = shingles(found)
            marks = signatures(values, offsets)
            keys = [hashlib.blake2b(values[a:b], digest_size=16).hexdigest() if b > a else None for a, b in zip(offsets, offsets[1:])]
            yield pa.record_batch({
                "doc_id": part.column("doc_id"), "version": part.column("version"), "n_shingles": pa.array(np.diff(offsets), pa.int64()),
                "set_key": pa.array(keys, pa.string()), "signature": pa.array([m.tobytes() for m in marks.astype(np.uint8)], pa.binary()),
                "tokens": pa.array([m.tobytes() for m in marks[:, :TREES]], pa.binary()),
            })


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, found in _row_slices(batch):
            values, offsets = shingles(found)
            packed = np.ascontiguousarray((values >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :_SET_BYTES])
            yield pa.record_batch({
                "doc_id": part.column("doc_id"), "n": pa.array(np.diff(offsets), pa.int64()),
                "set": pa.array([packed[a:b].tobytes() for a, b in zip(offsets, offsets[1:])], pa.binary()),
            })


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // _SET_BYTES, 8), np.uint8)
    out[:, :_SET_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, _SET_BYTES)
    return out.view(np.uint64).ravel()


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for left, right in zip(batch.column("left"), batch.column("right")):
            x, y = _unpacked(left.as_py()), _unpacked(right.as_py())
            common = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * common >= PERCENT * (len(x) + len(y) - common))
        yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "linked": pa.array(linked, pa.bool_())})


def _marks(signature: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signature.to_pylist()), np.uint8).reshape(-1, MINHASHES)


def _first_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(-1, TREES).astype(np.uint64)
            for tree in range(TREES):
                node = mix(np.full(len(tokens), np.uint64(tree)), tokens[:, tree])
                yield pa.record_batch({
                    "path": pa.array(np.full(len(tokens), tree), pa.int64()), "node": pa.array(node.view(np.int64)), "id": batch.column("doc_id"),
                })


# Keeps the uses of a path's hash apart, and all of them off zero, which `mix` maps to itself.
_COUNT, _BRANCH, _FACTOR, _MASK = (np.uint64(0x632BE59BD9B4E019 * i % (1 << 64)) for i in (1, 2, 3, 4))


def _next_paths(path: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the paths that go on, one for each branch, and the paths that they go on as."""
    count = np.full(len(path), BRANCHES) if first else 1 + (mix(path, _COUNT) % np.uint64(3) == 0)
    place = np.repeat(np.arange(len(path)), count)
    branch = np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
    return place, mix(mix(path[place], _BRANCH), branch.astype(np.uint64) + _BRANCH)


def _branched(first: bool):
    """Vertices with their sets and the paths and nodes they are in, to the nodes one step below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, nodes, ids = [], [], []
            for id_, set_, path, node in zip(*(batch.column(c) for c in ("id", "set", "paths", "nodes"))):
                values = _unpacked(set_.as_py())
                path, node = (np.array(x.as_py(), np.int64).view(np.uint64) for x in (path, node))
                place, path = _next_paths(path, first)
                factors, masks = mix(path, _FACTOR) | np.uint64(1), mix(path, _MASK)
                tokens = np.array([((values ^ m) * f >> np.uint64(32)).min() for f, m in zip(factors, masks)], np.uint64)
                paths.append(path)
                nodes.append(mix(mix(node[place], path), tokens))
                ids.append(np.full(len(path), id_.as_py()))
            if ids:
                path, node, id_ = (np.concatenate(x) for x in (paths, nodes, ids))
                yield pa.record_batch({"path": pa.array(path.view(np.int64)), "node": pa.array(node.view(np.int64)), "id": pa.array(id_, pa.int64())})

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole nodes, several at a time, from batches sorted by node."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        node = batch.column("node").to_numpy()
        last = int(np.searchsorted(node, node[-1]))
        if last:
            held[-1] = batch.slice(0, last)
            yield pa.Table.from_batches(held).combine_chunks()
            held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _alike(node: np.ndarray, marks: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of pairs in one node whose signatures agree often enough, and how often; node by lag."""
    lag = 1
    places = np.arange(len(node))
    while True:
        places = places[places + lag < len(node)]
        places = places[node[places] == node[places + lag]]
        if not len(places):
            return
        for at in range(0, len(places), 1 << 16):
            part = places[at : at + (1 << 16)]
            agree = (marks[part] == marks[part + lag]).sum(axis=1)
            good = agree >= least
            if good.any():
                yield part[good], part[good] + lag, agree[good]
        lag += 1


def _forest(least: int):
    """Per node a spanning forest of the pairs whose signatures agree often enough, the likeliest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            node, ids = table.column("node").to_numpy(), table.column("id").to_numpy()
            found = list(_alike(node, _marks(table.column("signature")), least))
            if not found:
                continue
            x, y, agree = (np.concatenate(part) for part in zip(*found))
            order = np.lexsort((np.maximum(ids[x], ids[y]), np.minimum(ids[x], ids[y]), -agree))
            parent = list(range(len(ids)))

            def top(i: int) -> int:
                while parent[i] != i:
                    parent[i] = i = parent[parent[i]]
                return i

            kept = []
            for i, (p, q) in zip(order.tolist(), zip(x[order].tolist(), y[order].tolist())):
                if (s := top(p)) != (t := top(q)):
                    parent[s] = t
                    kept.append(i)
            yield _pairs(node, ids, x[kept], y[kept])

    return run


def _pairs(node: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({
        "node": pa.array(node[x]), "a": pa.array(np.minimum(ids[x], ids[y])), "b": pa.array(np.maximum(ids[x], ids[y])),
    })


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a cell, the vertices outside the main component that could be linked to another label, and those they could be linked to."""
    for table in _groups(batches):
        node, ids, label, outside = (table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "id", "label", "outside"))
        marks, n = _marks(table.column("signature")), table.column("n").to_numpy()
        edges = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True])
        wanted = np.zeros(len(ids), bool)
        for a, b in zip(edges, edges[1:]):
            inside, out = a + np.flatnonzero(~outside[a:b]), a + np.flatnonzero(outside[a:b])
            if len(inside):
                others, sizes = np.ascontiguousarray(marks[inside].T), n[inside]
                for one in out:
                    agree = (others == marks[one][:, None]).sum(axis=0, dtype=np.uint8)
                    # Sets are linked only if the smaller one has so many of the larger one's shingles.
                    alike = 100 * np.minimum(sizes, n[one]) >= PERCENT * np.maximum(sizes, n[one])
                    good = (agree >= AGREE) & alike & (label[inside] != label[one])
                    wanted[inside[good]] = True
                    wanted[one] |= good.any()
        if wanted.any():
            yield pa.record_batch({
                "node": pa.array(node[wanted]), "id": pa.array(ids[wanted]), "label": pa.array(label[wanted]), "outside": pa.array(outside[wanted]),
            })


def common(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets with all others."""
    sizes = np.array([len(x) for x in [*sets, *others]])
    values, column, times = np.unique(np.concatenate([*sets, *others]), return_inverse=True, return_counts=True)
    shared = times > 1  # a value of one set is in no intersection
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = np.repeat(np.arange(len(sizes)), sizes)[keep], place[column[keep]]
    out = np.zeros((len(sets), len(others)), np.float32)
    for low in range(0, int(shared.sum()), 2048):
        here = (column >= low) & (column < low + 2048)
        incidence = np.zeros((len(sizes), 2048), np.float32)
        incidence[row[here], column[here] - low] = 1
        out += incidence[: len(sets)] @ incidence[len(sets) :].T
    return out.astype(np.int64)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the outsiders of a node and a part of it, one for each outsider and label."""
    for table in _groups(batches):
        node, ids, label, outside = (table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "id", "label", "outside"))
        edges = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True])
        for a, b in zip(edges, edges[1:]):
            inside, out = a + np.flatnonzero(~outside[a:b]), a + np.flatnonzero(outside[a:b])
            if not (len(inside) and len(out)):
                continue
            members, outsiders = ([_unpacked(x.as_py()) for x in table.column("set").take(pa.array(i))] for i in (inside, out))
            both = common(outsiders, members)
            union = np.array([len(x) for x in outsiders])[:, None] + np.array([len(x) for x in members]) - both
            x, y = np.nonzero((100 * both >= PERCENT * union) & (label[out][:, None] != label[inside]))
            _, one = np.unique(np.stack([x, label[inside][y]]), axis=1, return_index=True)
            yield _pairs(node, ids, out[x[one]], inside[y[one]])


_PAIRS = "node bigint, a bigint, b bigint"
_MEMBERS = "path bigint, node bigint, id bigint"
_PROFILES = "doc_id bigint, version bigint, n_shingles bigint, set_key string, signature binary, tokens binary"


def _version(text: Column) -> Column:
    return F.xxhash64(text)


class Join:
    """One run of the similarity join over a table of documents."""

    def __init__(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"):
        self.work = Workspace(docs.sparkSession, "near")
        self.rows = texts(docs, id_column, text_column).withColumn("version", _version(F.col("text")))
        self.profiles = self.work.write(self.rows.mapInArrow(_profiles, _PROFILES), "profiles")
        keys = self.profiles.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("id"))
        self.keys = self.work.write(keys, "keys")
        self.vertices = self.work.write(self._first_of_sets(self.profiles), "vertices")
        self._steps = 0

    def _first_of_sets(self, profiles: DataFrame) -> DataFrame:
        """doc_id, signature and tokens of the vertices among the rows."""
        ids = self.keys.select(F.col("id").alias("doc_id"), "set_key")
        return profiles.join(ids, ["doc_id", "set_key"]).dropDuplicates(["doc_id", "set_key"]).select("doc_id", "signature", "tokens")

    def _name(self, what: str) -> str:
        self._steps += 1
        return f"{what}{self._steps}"

    def _signed(self, members: DataFrame) -> DataFrame:
        return members.join(self.vertices.select(F.col("doc_id").alias("id"), "signature"), "id")

    def _sets_of(self, ids: DataFrame, id_column: str) -> DataFrame:
        """The ids' sets as ``id_column`` and ``set``, and a few more: the other sets are not shuffled."""
        return among(self.sets, F.col("doc_id"), ids, id_column).select(F.col("doc_id").alias(id_column), "set")

    def _by_node(self, members: DataFrame, run, schema: str = _PAIRS) -> DataFrame:
        count = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        columns = [c for c in ("node", "id", "signature", "label", "outside", "n", "set") if c in members.columns]
        return members.select(*columns).repartition(count, "node").sortWithinPartitions("node").mapInArrow(run, schema)

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """a, b, linked of the distinct pairs, judged on the full sets."""
        pairs = self.work.write(pairs.select("a", "b").where("a <> b").distinct(), self._name("pairs"))
        left, right = (self._sets_of(pairs, end).withColumnRenamed("set", side) for end, side in (("a", "left"), ("b", "right")))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
        judged = both.mapInArrow(_confirmed, "a bigint, b bigint, linked boolean")
        return self.work.write(judged.groupBy("a", "b").agg(F.max("linked").alias("linked")), self._name("judged"))

    def links(self) -> DataFrame:
        """Confirmed links (a, b) that connect all that is linked."""
        members = self.work.write(self.vertices.select("doc_id", "tokens").mapInArrow(_first_nodes, _MEMBERS), "members")
        sizes = self.work.write(members.groupBy("node").count().where("count > 1"), "sizes")
        small = self.work.write(members.join(sizes.where(F.col("count") <= NODE).select("node"), "node"), "small")
        large = self.work.write(members.join(sizes.where(F.col("count") > NODE), "node"), "large")
        blocks = F.ceil(F.col("count") / BLOCK)
        dealt = large.withColumn("node", F.xxhash64("node", F.pmod(F.xxhash64("id", "path"), blocks)))
        forest = self._by_node(self._signed(small), _forest(AGREE)).unionByName(self._by_node(self._signed(dealt), _forest(LIKELY)))
        forest = self.work.write(forest, "forest")
        # Whatever is confirmed later is in a forest or in a large node.
        needed = forest.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(large.select(F.col("id").alias("doc_id")))
        # The texts stay where they are; sets of a few vertices more do no harm.
        sets = among(self.rows, F.col("doc_id"), needed, "doc_id").mapInArrow(_sets, "doc_id bigint, n bigint, set binary")
        self.sets = self.work.write(sets, "sets")
        judged = self.confirm(forest)
        links = judged.where("linked").select("a", "b")
        open_ = forest.join(judged.where("not linked").select("a", "b"), ["a", "b"]).select("node").distinct()
        members = self.work.write(small.join(open_, "node").unionByName(large.drop("count")), "open")
        if members.isEmpty():
            return links
        return links.unionByName(self._further(members, self.work.write(components(links), "labels")))

    def _further(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """Links between the labels of a node; nodes with too many vertices outside their main label are branched."""
        found, depth = None, 0
        while True:
            depth += 1
            size = members.count()
            known = members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
            known = self.work.write(sized(known, size), self._name("known"))
            counts = known.groupBy("node", "label").count()
            main = counts.groupBy("node").agg(
                F.max_by("label", F.struct("count", "label")).alias("main"), (F.sum("count") - F.max("count")).alias("outside")
            )
            main = self.work.write(sized(main.where("outside > 0"), size), self._name("main"))
            ends = self._across(known.join(main.where(F.col("outside") <= OUTSIDE).drop("outside"), "node"), size)
            found = ends if found is None else found.unionByName(ends)
            if main.where(F.col("outside") > OUTSIDE).isEmpty():
                return found
            branched = known.join(main.where(F.col("outside") > OUTSIDE).select("node"), "node")
            of = branched.groupBy("id").agg(F.collect_list("path").alias("paths"), F.collect_list("node").alias("nodes"))
            filled = of.join(self._sets_of(branched, "id"), "id")
            members = self.work.write(filled.mapInArrow(_branched(depth == 1), _MEMBERS), self._name("members"))

    def _across(self, members: DataFrame, size: int) -> DataFrame:
        """Links in nodes between what belongs to the main component and what doesn't, or both don't; ``size`` rows at most."""
        sizes = self.sets.select(F.col("doc_id").alias("id"), "n")
        members = members.join(sizes, "id").withColumn("outside", F.col("label") != F.col("main"))
        members = self.work.write(sized(members.drop("path", "main"), size), self._name("ends"))

        def cells(test: Column, most: int) -> Column:
            return F.ceil(F.greatest(F.count_if(test) / most, F.sum(F.when(test, F.col("n"))) / CELL))

        counts = members.groupBy("node").agg(cells(F.lit(True), PART).alias("parts"), cells(F.col("outside"), CHUNK).alias("chunks"))
        members = members.join(counts, "node")

        def dealt(name: str) -> Column:
            return F.pmod(F.xxhash64("id", F.lit(name)), F.col(name))

        def each(name: str) -> Column:
            return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(name) - 1))

        # Every chunk of those outside meets every part of the node, which they are in as well.
        inside = members.withColumn("outside", F.lit(False)).withColumn("part", dealt("parts")).withColumn("chunk", each("chunks"))
        outside = members.where("outside").withColumn("part", each("parts")).withColumn("chunk", dealt("chunks"))
        cells_ = inside.unionByName(outside).withColumn("node", F.xxhash64("node", "chunk", "part"))
        likely = self._by_node(self._signed(cells_), _likely, "node bigint, id bigint, label bigint, outside boolean")
        likely = self.work.write(likely, self._name("likely"))
        filled = likely.join(self._sets_of(likely, "id"), "id")
        return self.work.write(self._by_node(filled, _across).select("a", "b").distinct(), self._name("across"))

    def verdicts(self) -> DataFrame:
        """doc_id, version (hash of the text), n_shingles, component_id (smallest id reachable), kept of every row with an id."""
        labels = self.work.write(components(self.links()), self._name("labels"))
        keys = self.keys.join(labels, "id", "left").select("set_key", F.coalesce("label", "id").alias("component"))
        keys = self.work.write(keys, self._name("classes"))
        out = self.profiles.select("doc_id", "version", "n_shingles", "set_key").join(keys, "set_key", "left")
        out = out.select("doc_id", "version", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row with an id."""
    return Join(docs, id_column, text_column).verdicts().drop("version")


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, all columns, that have the smallest id of their component; rows without an id stay."""
    dropped = Join(docs, id_column, text_column).verdicts().where("not kept")
    # Of an id with several texts only those go that are not kept.
    dropped = dropped.select(F.col("doc_id").alias("_dropped"), F.col("version").alias("_version")).distinct()
    dropped = Workspace(docs.sparkSession, "near").write(dropped, "dropped")
    version = _version(F.coalesce(F.col(text_column).cast("string"), F.lit("")))
    return docs.join(dropped, (F.col(id_column).cast("bigint") == F.col("_dropped")) & (version == F.col("_version")), "left_anti")
