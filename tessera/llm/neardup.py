"""Embedding near-dedup: a hierarchical navigable small-world graph per shard, all shards queried, links verified."""

from __future__ import annotations

import heapq
import io
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, file_system, new_path, stored
from .jaccard import group_starts, groups, spanning


class Graph:
    """A small-world graph over unit vectors (float32 rows), searched by inner product.

    Layer 0 holds all rows with up to 2 m neighbours, each higher layer about 1 in m of the layer below. Neighbours are
    chosen so that they differ from each other, then filled up with the nearest, which keeps dense groups connected.
    After the build each row is searched for; a row that is not met gets links from its nearest rows in spare places.
    """

    SPARE = 8

    def __init__(self, vectors: np.ndarray, m: int = 12, beam: int = 48, seed: int = 7):
        self.x, self.m = np.ascontiguousarray(vectors, dtype=np.float32), m
        n = len(self.x)
        draw = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(m)).astype(np.int64), 12)
        self.links = [np.full((n, 2 * m + self.SPARE), -1, dtype=np.int32)]
        self.rows = [None] + [np.flatnonzero(self.level >= k) for k in range(1, int(self.level.max(initial=0)) + 1)]
        self.place = [None]
        for r in self.rows[1:]:
            at = np.full(n, -1, dtype=np.int32)
            at[r] = np.arange(len(r))
            self.place.append(at)
            self.links.append(np.full((len(r), m), -1, dtype=np.int32))
        self.seen, self.stamp = np.zeros(n, dtype=np.int64), 0
        self.entry = 0
        for i in range(1, n):
            self._insert(i, beam)
        for i in range(n):
            self._mend(i)

    def _near(self, k: int, i: int) -> np.ndarray:
        own = self.links[k][i if k == 0 else self.place[k][i]]
        return own[: int((own >= 0).sum())]

    def _set(self, k: int, i: int, to: np.ndarray) -> None:
        own = self.links[k][i if k == 0 else self.place[k][i]]
        own[: len(to)] = to
        own[len(to) :] = -1

    def _choose(self, q: np.ndarray, rows: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        if len(rows) <= most:
            return rows
        order = np.argsort(-sims, kind="stable")
        rows, sims = rows[order], sims[order]
        with_each = self.x[rows] @ self.x[rows].T
        alive, kept = np.ones(len(rows), dtype=bool), []
        while len(kept) < most:
            k = int(alive.argmax())
            if not alive[k]:
                break
            kept.append(k)
            alive &= with_each[k] <= sims
            alive[k] = False
        if len(kept) < most:
            rest = np.ones(len(rows), dtype=bool)
            rest[kept] = False
            kept += np.flatnonzero(rest)[: most - len(kept)].tolist()
        return rows[kept]

    def _beam(self, q: np.ndarray, starts: list[int], ef: int, k: int) -> list[tuple[float, int]]:
        """The ef best rows of layer k that the search meets, as (similarity, row)."""
        self.stamp += 1
        seen, stamp, x = self.seen, self.stamp, self.x
        best = [(float(x[s] @ q), s) for s in starts]
        for _, s in best:
            seen[s] = stamp
        todo = [(-d, s) for d, s in best]
        heapq.heapify(best)
        heapq.heapify(todo)
        while todo:
            d, c = heapq.heappop(todo)
            if len(best) >= ef and -d < best[0][0]:
                break
            near = self._near(k, c)
            near = near[seen[near] != stamp]
            if not len(near):
                continue
            seen[near] = stamp
            sims = x[near] @ q
            if len(best) >= ef:
                good = sims > best[0][0]
                near, sims = near[good], sims[good]
            for s, i in zip(sims.tolist(), near.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (s, i))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, i))
                else:
                    continue
                heapq.heappush(todo, (-s, i))
        return best

    def _insert(self, i: int, beam: int) -> None:
        q, top = self.x[i], int(self.level[self.entry])
        at = [self.entry]
        for k in range(top, int(self.level[i]), -1):
            at = [max(self._beam(q, at, 1, k))[1]]
        for k in range(min(top, int(self.level[i])), -1, -1):
            found = self._beam(q, at, beam, k)
            rows = np.array([r for _, r in found], dtype=np.int32)
            sims = np.array([s for s, _ in found], dtype=np.float32)
            mine = self._choose(q, rows, sims, self.m)
            self._set(k, i, mine)
            most = 2 * self.m if k == 0 else self.m
            for r in mine.tolist():
                own = self._near(k, r)
                if len(own) < most:
                    self.links[k][r if k == 0 else self.place[k][r]][len(own)] = i
                else:
                    own = np.append(own, np.int32(i))
                    self._set(k, r, self._choose(self.x[r], own, self.x[own] @ self.x[r], most))
            at = [r for _, r in found]
        if self.level[i] > top:
            self.entry = i

    def _mend(self, i: int) -> None:
        q = self.x[i]
        met = self.within(q, float(q @ q) - 1e-5, 24, 0.06)
        if i in met:
            return
        near = sorted(self._beam(q, self._down(q), 24, 0), reverse=True)
        added = 0
        for _, r in near:
            own = self._near(0, r)
            if r != i and len(own) < self.links[0].shape[1] and i not in own:
                self.links[0][r][len(own)] = i
                added += 1
                if added == 4:
                    break

    def _down(self, q: np.ndarray) -> list[int]:
        """Where the search of layer 0 begins."""
        at = [self.entry]
        for k in range(int(self.level[self.entry]), 0, -1):
            at = [max(self._beam(q, at, 1, k))[1]]
        return at

    def within(self, q: np.ndarray, least: float, ef: int, slack: float) -> np.ndarray:
        """Rows of similarity >= least that are met: the beam's, and all reached from these over rows >= least - slack."""
        found = [r for s, r in self._beam(q, self._down(q), ef, 0) if s >= least - slack]
        if not found:
            return np.zeros(0, dtype=np.int64)
        self.stamp += 1
        front = np.array(found, dtype=np.int64)
        self.seen[front] = self.stamp
        parts = [front]
        while len(front):
            near = self.links[0][front].reshape(-1)
            near = np.unique(near[near >= 0])
            near = near[self.seen[near] != self.stamp]
            self.seen[near] = self.stamp
            front = near[self.x[near] @ q >= least - slack].astype(np.int64)
            parts.append(front)
        rows = np.concatenate(parts)
        return rows[self.x[rows] @ q >= least]

    def dump(self) -> bytes:
        out = io.BytesIO()
        parts = {f"links{k}": v for k, v in enumerate(self.links)}
        np.savez(out, x=self.x, m=self.m, level=self.level, entry=self.entry, layers=len(self.links), **parts)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Graph:
        got = np.load(io.BytesIO(raw))
        g = cls.__new__(cls)
        g.x, g.m, g.level, g.entry = got["x"], int(got["m"]), got["level"], int(got["entry"])
        g.links = [got[f"links{k}"] for k in range(int(got["layers"]))]
        g.place = [None]
        for k in range(1, len(g.links)):
            at = np.full(len(g.x), -1, dtype=np.int32)
            r = np.flatnonzero(g.level >= k)
            at[r] = np.arange(len(r))
            g.place.append(at)
        g.seen, g.stamp = np.zeros(len(g.x), dtype=np.int64), 0
        return g


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def planted(shard: np.ndarray, cosine: float, most: int) -> np.ndarray:
    """Unit rows at that cosine from rows spread over the shard, one for each; the same for the same shard."""
    x = shard[np.unique(np.linspace(0, len(shard) - 1, min(most, len(shard))).astype(np.int64))]
    off = np.random.default_rng(11).normal(size=x.shape)
    off -= (off * x).sum(1, keepdims=True) * x
    size = np.sqrt((off * off).sum(1, keepdims=True))
    # in one dimension nothing stands off
    return np.where(size > 1e-9, cosine * x + np.sqrt(1 - cosine * cosine) * off / np.maximum(size, 1e-9), x)


def search(graph: Graph, shard: np.ndarray, queries: np.ndarray, least: float, target: float, audit: int) -> list[np.ndarray]:
    """For each query the rows of the shard with cosine >= least in double precision (both hold unit rows).

    The beam doubles, and the slack grows, until the links found for the audited vectors reach the target share of those
    that brute force finds for them; a beam as wide as the shard finds all. Audited are `audit` queries spread over the
    block, and as many vectors made to stand just within the threshold of rows of the shard, so that each audit holds
    links at the threshold which no vector has with itself.
    """
    some = np.unique(np.linspace(0, len(queries) - 1, min(audit, len(queries))).astype(np.int64))
    probes = np.concatenate([queries[some], planted(shard, least + (1 - least) / 20, audit)])
    true = (probes @ shard.T >= least).sum()

    def links(q: np.ndarray, ef: int, slack: float) -> np.ndarray:
        if ef >= len(shard):
            return np.flatnonzero(shard @ q >= least)
        rows = graph.within(q.astype(np.float32), least - 1e-4, ef, slack)
        return rows[shard[rows] @ q >= least]

    ef, slack = 24, 0.06
    while sum(len(links(q, ef, slack)) for q in probes) < target * true and ef < len(shard):
        ef, slack = min(2 * ef, len(shard)), 2 * slack
    return [links(q, ef, slack) for q in queries]


def link_embeddings(vectors: DataFrame, least: float = 0.98, shard_rows: int = 20_000, block: int = 5_000, target: float = 1.0, audit: int = 64, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors are compared when labels are equal and not null and lengths are equal. Null, zero and empty vectors, those
    with a null or non-finite component and those without a vec_id link with nothing. Equal vectors of a label are
    searched once, as one row with a count, and link with each other. Rows that repeat a vec_id are vectors of their
    own. A vector that links with nothing is its own component; a null vec_id has a null component and is not kept.
    Each (label, length) is dealt by hash to shards of about shard_rows distinct vectors; a task builds one shard's
    graph and writes it to the shared folder, other tasks search it with blocks of queries. An empty table gives an
    empty table.
    """
    spark = vectors.sparkSession
    folder = new_path(spark, "graphs")
    e = F.col(embedding).cast("array<double>")
    usable = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.coalesce(F.size(e) > 0, F.lit(False)) & F.coalesce(F.forall(e, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False)) & F.coalesce(F.exists(e, lambda x: x != 0), F.lit(False))
    # + 0.0 makes one of both zeros
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.when(usable, F.transform(e, lambda x: x + F.lit(0.0))).alias("e"))
    keyed = rows.withColumn("key", F.when(F.col("e").isNotNull(), F.unhex(F.md5(F.concat_ws("|", "label", F.array_join(F.transform("e", lambda x: x.cast("string")), ","))))))
    ids = stored(keyed.select("vec_id", "key"), "vectors")
    nodes = stored(keyed.where("key is not null").groupBy("key").agg(F.first("label").alias("label"), F.first("e").alias("e"), F.count("*").alias("copies"), F.min("vec_id").alias("rep")).withColumn("size", F.size("e")), "distinct-vectors")
    sizes = nodes.groupBy("label", "size").agg(F.count("*").alias("n"))
    sharded = stored(nodes.join(sizes, ["label", "size"]).withColumn("shards", F.ceil(F.col("n") / shard_rows).cast("int")).withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int")), "sharded")

    def build(key, t):
        import pyarrow as pa

        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        t = t.sort_by("key")
        x = unit(np.array(t.column("e").to_pylist(), dtype=np.float64).reshape(t.num_rows, -1))
        name = f"{path}/{uuid.uuid4().hex}.npz"
        out = io.BytesIO()
        np.savez(out, graph=np.frombuffer(Graph(x).dump(), dtype=np.uint8), x=x, copies=t.column("copies").to_numpy(), keys=np.frombuffer(b"".join(t.column("key").to_pylist()), dtype=np.uint8).reshape(-1, 16))
        with fs.open_output_stream(f"{name}.part") as f:
            f.write(out.getvalue())
        fs.move(f"{name}.part", name)
        return pa.table({"label": pa.array([key[0].as_py()]), "size": pa.array([key[1].as_py()], pa.int32()), "path": pa.array([name])})

    # a shard is little data and much work: as many tasks as shards, which adaptive execution does not put together
    n_shards = max(1, sharded.select("label", "size", "shard").distinct().count())
    graphs = stored(sharded.select("label", "size", "shard", "key", "e", "copies").repartition(n_shards, "label", "size", "shard").groupBy("label", "size", "shard").applyInArrow(build, "label string, size int, path string"), "graphs")

    def query(batches):
        import pyarrow as pa

        fs, _ = file_system(folder)
        for t in groups(batches, ("path", "part")):
            starts = group_starts(t, ("path", "part")).tolist()
            for s, end in zip(starts[:-1], starts[1:], strict=True):
                g = t.slice(s, end - s)
                with fs.open_input_file(g.column("path")[0].as_py()) as f:
                    got = np.load(io.BytesIO(f.read()))
                graph, keys, copies = Graph.load(got["graph"].tobytes()), [k.tobytes() for k in got["keys"]], got["copies"]
                q = unit(np.array(g.column("e").to_pylist(), dtype=np.float64).reshape(g.num_rows, -1))
                own = g.column("key").to_pylist()
                at = {k: i for i, k in enumerate(keys)}
                found = search(graph, got["x"], q, least, target, audit)
                n = [int(copies[r].sum()) - (int(copies[at[k]]) if (k in at and (r == at[k]).any()) else 0) for k, r in zip(own, found, strict=True)]
                a = np.repeat(np.arange(len(own)), [len(r) for r in found])
                b = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)
                place = np.array([at.get(k, len(keys) + i) for i, k in enumerate(own)], dtype=np.int64)
                label = spanning(len(keys) + len(own), place[a], b)
                names = keys + own
                yield from pa.table({"key": pa.array(own, pa.binary()), "to": pa.array([names[label[p]] for p in place.tolist()], pa.binary()), "links": pa.array(n, pa.int64())}).to_batches()

    parts = sharded.select("label", "size", "key", "e", F.pmod(F.xxhash64("key", F.lit(3)), F.ceil(F.col("n") / block)).cast("int").alias("part"))
    asked = parts.join(graphs, ["label", "size"]).select("path", "part", "key", "e")
    asked = asked.repartition(max(1, asked.select("path", "part").distinct().count()), "path", "part").sortWithinPartitions("path", "part")
    found = stored(asked.mapInArrow(query, "key binary, to binary, links long"), "links")
    roots = components(found.select(F.col("key").alias("a"), F.col("to").alias("b"))).select(F.col("node").alias("key"), "root")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    placed = stored(nodes.select("key", "copies", "rep").join(links, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "placed")
    least_id = stored(placed.groupBy("root").agg(F.min("rep").alias("component_id")), "least-ids")
    of = stored(placed.join(least_id, "root").select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "components")
    out = ids.join(of, "key", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
