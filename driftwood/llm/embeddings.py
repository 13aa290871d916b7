"""Near-duplicate embeddings: a hierarchical navigable small-world graph for each shard, every shard queried.

Equal vectors are one class.  Classes are dealt to shards by hash; one task builds a shard's graph, layer by layer from the
top, adding nodes in batches that search the layer built so far, and audits it: the beam doubles until samples of the
shard's rows, and of vectors at exactly the threshold from a row, find their links.  Then every class is searched in
every shard: a task holds one graph and streams the queries past it.  Queries whose beams are full of links share their
neighbourhood: it is walked once for all of them, and matrix products tell who links with whom.  Cosines near the
threshold are taken in double precision; a task sends a spanning forest of its links, not the links, and stars over
these forests give the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwood.llm.common import drop, materialize, table, tune
from driftwood.llm.components import components

#: Classes of a shard, at most about; fewer than SHARDS shards are never made.  Queries that one task streams past a graph.
SHARD_ROWS, SHARDS, SLICE_ROWS = 100_000, 6, 200_000
NEIGHBOURS, BEAM, FIRST_BEAM = 16, 32, 16
#: Share of true links that the audit asks for, and the rows of each of its samples.
RECALL, AUDIT = 0.99, 48
#: Queries searched in step; rows of a step of a region; upper layers of at most so many rows are searched whole.
LOCKSTEP, STEP, FLAT = 256, 2048, 2048
#: What a row of a region may lack to the threshold and still lead on.
SLACK = 0.02


def _best(ids: np.ndarray, sims: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The width best of each row, best first; ids below 0 are empty."""
    order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def beam(links: np.ndarray, vectors: np.ndarray, queries: np.ndarray, start: np.ndarray, width: int, expand: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries in step: (queries x width) ids and similarities, best first.  start: ids, one row a query.

    What a query has seen is kept in a table of a size set by the beam; an overwritten entry costs a second look at a
    node, nothing else, since a node that left the beam can't come back and one that is in it is dropped as a repeat.
    """
    q, k = start.shape
    ids = np.full((q, width + k), -1, np.int64)
    sims = np.full((q, width + k), -np.inf, np.float32)
    ids[:, :k] = np.sort(start, 1)
    sims[:, :k] = np.einsum("qd,qkd->qk", queries, vectors[ids[:, :k]])
    sims[:, 1:k][ids[:, 1:k] == ids[:, : k - 1]] = -np.inf
    ids[sims == -np.inf] = -1
    ids, sims = _best(ids, sims, width)
    opened = np.zeros((q, width), bool)
    slots = 1 << max(8, int(16 * width).bit_length())
    seen = np.full((q, slots), -1, np.int32)
    row, col = np.nonzero(ids >= 0)
    seen[row, ids[row, col] & (slots - 1)] = ids[row, col]
    live = np.arange(q)
    while True:
        todo = (ids[live] >= 0) & ~opened[live]
        some = todo.any(1)
        live, todo = live[some], todo[some]
        if not len(live):
            return ids, sims
        at = np.argsort(~todo, axis=1, kind="stable")[:, :expand]
        row, col = np.nonzero(np.take_along_axis(todo, at, 1))
        col = at[row, col]
        opened[live[row], col] = True
        near = links[ids[live[row], col]]
        node = near.ravel()
        who = np.repeat(row, near.shape[1])
        new = (node >= 0) & (seen[live[who], node & (slots - 1)] != node)
        who, node = who[new], node[new]
        seen[live[who], node & (slots - 1)] = node
        near = np.einsum("md,md->m", vectors[node], queries[live[who]])
        better = near > sims[live[who], -1]
        who, node, near = who[better], node[better], near[better]
        if not len(who):
            continue
        first = np.searchsorted(who, np.arange(len(live) + 1))
        got = np.flatnonzero(first[1:] > first[:-1])  # the others' beams stay as they are
        most = int((first[1:] - first[:-1]).max())
        place = np.searchsorted(got, who), width + np.arange(len(who)) - first[who]
        at = live[got]
        more_ids = np.full((len(got), width + most), -1, np.int64)
        more_sims = np.full((len(got), width + most), -np.inf, np.float32)
        more_open = np.zeros((len(got), width + most), bool)
        more_ids[:, :width], more_sims[:, :width], more_open[:, :width] = ids[at], sims[at], opened[at]
        more_ids[place], more_sims[place] = node, near
        order = np.argsort(-more_sims, axis=1, kind="stable")
        more_ids, more_sims, more_open = (np.take_along_axis(x, order, 1) for x in (more_ids, more_sims, more_open))
        again = np.zeros(more_ids.shape, bool)
        again[:, 1:] = (more_ids[:, 1:] == more_ids[:, :-1]) & (more_ids[:, 1:] >= 0)
        if again.any():
            more_sims[again], more_ids[again] = -np.inf, -1
            order = np.argsort(-more_sims, axis=1, kind="stable")
            more_ids, more_sims, more_open = (np.take_along_axis(x, order, 1) for x in (more_ids, more_sims, more_open))
        ids[at], sims[at], opened[at] = more_ids[:, :width], more_sims[:, :width], more_open[:, :width]


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the sets of a[i] and b[i]; parent points each node at the least of its set, and is kept flat."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _diverse(base: np.ndarray, ids: np.ndarray, sims: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Up to most ids of each row (sorted, best first): those closer to the row's vector than to any chosen before, then the best others."""
    q, k = ids.shape
    x = vectors[ids]
    between = x @ x.transpose(0, 2, 1)
    chosen = np.zeros((q, k), bool)
    count = np.zeros(q, np.int64)
    for j in range(k):
        blocked = (chosen[:, :j] & (between[:, j, :j] > sims[:, j : j + 1])).any(1)
        ok = (ids[:, j] >= 0) & ~blocked & (count < most)
        chosen[:, j] = ok
        count += ok
    rank = np.where(ids < 0, 2 * k, np.where(chosen, 0, k) + np.arange(k))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def layer(vectors: np.ndarray, neighbours: int = NEIGHBOURS, width: int = BEAM, seed: int = 0) -> np.ndarray:
    """Links (nodes x 2 * neighbours, -1: none) of a navigable small-world graph over unit vectors."""
    n, most = len(vectors), 2 * neighbours
    links = np.full((n, most), -1, np.int32)
    done = min(n, 512)
    if done > 1:
        sims = vectors[:done] @ vectors[:done].T
        np.fill_diagonal(sims, -np.inf)
        ids, sims = _best(np.broadcast_to(np.arange(done), sims.shape), sims, min(done - 1, width))
        links[:done] = _diverse(vectors[:done], ids, sims, vectors, most)
    while done < n:
        end = min(n, done + min(done, 2048))
        for lo in range(done, end, LOCKSTEP):
            hi = min(end, lo + LOCKSTEP)
            rng = np.random.Generator(np.random.PCG64([seed, lo]))
            entry = rng.permutation(done)[:FLAT]
            start = vectors[lo:hi] @ vectors[entry].T
            start = entry[np.argpartition(-start, 3, axis=1)[:, :4]]
            ids, sims = beam(links[:done], vectors, vectors[lo:hi], start, width)
            own = vectors[lo:hi] @ vectors[done:end].T
            own[np.arange(hi - lo), np.arange(lo - done, hi - done)] = -np.inf
            mates = np.broadcast_to(np.arange(done, end), own.shape)
            if end - done > 32:
                mates, own = _best(mates, own, 32)
            mates = np.where(np.isfinite(own), mates, -1)
            ids, sims = _best(np.hstack((ids, mates)), np.hstack((sims, own)), width)
            links[lo:hi, :neighbours] = _diverse(vectors[lo:hi], ids, sims, vectors, neighbours)
        _back(links, vectors, done, end, most)
        done = end
    return _reachable(links, vectors)


def _reachable(links: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """links, with columns added where nodes that no path from node 0 leads to are hung below the nodes they link to themselves."""
    n = len(links)
    while n:
        seen = np.zeros(n + 1, bool)  # the last entry stands for no node
        front = np.zeros(1, np.int64)
        while len(front):
            seen[front] = True
            front = np.unique(links[front])
            front = front[(front >= 0) & ~seen[front]]
        lost = np.flatnonzero(~seen[:n])
        if not len(lost):
            break
        to = links[lost].astype(np.int64)
        ok = (to >= 0) & seen[to]
        near = ok.any(1)
        if near.any():
            child, to, ok = lost[near], to[near], ok[near]
            kth = np.arange(len(child)) % np.minimum(ok.sum(1), 4)  # spread over the first few, so that few columns are needed
            host = to[np.arange(len(child)), (np.cumsum(ok, 1) <= kth[:, None]).sum(1)]
        else:  # whole parts without a link to the rest
            child, rest = lost[:LOCKSTEP], np.flatnonzero(seen[:n])
            host = rest[(vectors[child] @ vectors[rest].T).argmax(1)]
        order = np.argsort(host, kind="stable")
        child, host = child[order], host[order]
        place = np.arange(len(host)) - np.searchsorted(host, host)
        more = np.full((n, int(place.max()) + 1), -1, links.dtype)
        more[host, place] = child
        links = np.hstack((links, more))
    return links


def _back(links: np.ndarray, vectors: np.ndarray, lo: int, hi: int, most: int) -> None:
    """Give each new link its opposite; a node with too many keeps a diverse choice."""
    new = links[lo:hi]
    src, dst = np.repeat(np.arange(lo, hi), new.shape[1]), new.ravel().astype(np.int64)
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.lexsort((-np.einsum("kd,kd->k", vectors[src], vectors[dst]), dst))  # where there are too many, the nearest count
    src, dst = src[order], dst[order]
    nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
    for part in np.array_split(np.arange(len(nodes)), max(1, len(nodes) // 512)):
        if not len(part):
            continue
        room = min(int(count[part].max()), 2 * most)
        k = np.minimum(np.arange(room)[None, :], count[part][:, None] - 1)
        extra = np.where(np.arange(room)[None, :] < count[part][:, None], src[first[part][:, None] + k], -1)
        old = links[nodes[part]].astype(np.int64)
        extra[(extra[:, :, None] == old[:, None, :]).any(2)] = -1
        ids = np.hstack((old, extra))
        sims = np.einsum("qd,qkd->qk", vectors[nodes[part]], vectors[ids])
        sims[ids < 0] = -np.inf
        ids, sims = _best(ids, sims, ids.shape[1])
        links[nodes[part]] = _diverse(vectors[nodes[part]], ids, sims, vectors, most)


class Graph:
    """Layers over the rows of unit vectors: layer 0 has all rows, each next one a sixteenth or so of them."""

    def __init__(self, vectors: np.ndarray, seed: int = 0):
        self.vectors = vectors
        rng = np.random.Generator(np.random.PCG64(seed))
        level = np.minimum(-np.log(1 - rng.random(len(vectors))) / np.log(NEIGHBOURS), 30).astype(int)
        self.rows, self.links = [], []
        for k in range(level.max(initial=0) + 1):
            rows = np.flatnonzero(level >= k)
            self.rows.append(rows)
            self.links.append(layer(vectors[rows], seed=k))

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        width = min(width, len(self.vectors))
        top = next((k for k in range(1, len(self.rows)) if len(self.rows[k]) <= FLAT), 0)  # layers above are within this one
        start = np.zeros((len(queries), 1), np.int64)
        if top:
            sims = queries @ self.vectors[self.rows[top]].T
            few = min(4, sims.shape[1])
            start = self.rows[top][np.argpartition(-sims, few - 1, axis=1)[:, :few]]
        for k in range((top or len(self.rows)) - 1, 0, -1):
            start = np.searchsorted(self.rows[k], start)
            ids, _ = beam(self.links[k], self.vectors[self.rows[k]], queries, start, min(4, len(self.rows[k])))
            start = self.rows[k][np.where(ids < 0, ids[:, :1], ids)]
        return beam(self.links[0], self.vectors, queries, start, width)

    def hits(self, queries: np.ndarray, least: float, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Parts (queries, rows, similarities) of all pairs found of a similarity of at least least; no pair comes twice.

        Full beams of queries that share a found row are one group, whose region is walked for all of them at once.
        """
        n = len(self.vectors)
        for lo in range(0, len(queries), LOCKSTEP):
            own = queries[lo : lo + LOCKSTEP]
            ids, sims = self.search(own, width)
            link = (sims >= least) & (ids >= 0)
            link[:, 1:] &= (ids[:, 1:] != ids[:, :-1]) | (sims[:, 1:] != sims[:, :-1])
            full = link.sum(1) * 2 >= link.shape[1]
            if link.shape[1] >= n:
                full[:] = False
            q, k = np.nonzero(link & ~full[:, None])
            yield q + lo, ids[q, k], sims[q, k]
            if not full.any():
                continue
            q, k = np.nonzero(link & full[:, None])
            found, anchor = ids[q, k], ids[:, 0]
            parent = np.arange(n)
            merge(parent, anchor[q], found)
            group = parent[anchor]
            for g in np.unique(group[full]):
                who = np.flatnonzero(full & (group == g))
                for x, r, s in self._region(own[who], np.unique(found[parent[found] == g]), least):
                    yield who[x] + lo, r, s

    def _region(self, queries: np.ndarray, front: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Hits among the rows that are reached from front over rows of a similarity of least - SLACK with any of the queries."""
        known = np.zeros(len(self.vectors), bool)
        known[front] = True
        while len(front):
            leads = []
            for lo in range(0, len(front), STEP):
                rows = front[lo : lo + STEP]
                sims = queries @ self.vectors[rows].T
                leads.append(rows[sims.max(0) >= least - SLACK])
                x, r = np.nonzero(sims >= least)
                yield x, rows[r], sims[x, r]
            front = np.unique(self.links[0][np.concatenate(leads)])
            front = front[front >= 0]
            front = front[~known[front]]
            known[front] = True

    def near(self, queries: np.ndarray, least: float, width: int) -> list[np.ndarray]:
        """For each query the rows of a similarity of at least least."""
        parts = list(self.hits(queries, least, width))
        q, r = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]) for i in (0, 1))
        order = np.argsort(q, kind="stable")
        return np.split(r[order], np.searchsorted(q[order], np.arange(1, len(queries))))

    def audited_width(self, queries: np.ndarray, least: float, own: np.ndarray | None = None) -> int:
        """The beam, doubled from FIRST_BEAM on, at which samples find RECALL of their links; the recall is kept in self.recall.

        Three samples have to pass: any queries that have links, queries with few, whose beams don't fill, and probes,
        which lie at the threshold from one row in a direction of their own, so that they are the hardest to find and are there
        in every table.  Recall is the mean over a sample, so that a query of many links counts once.  own: the row of each
        query itself, which isn't looked for, or -1.
        """
        n = len(self.vectors)
        pool = np.linspace(0, len(queries) - 1, min(4 * AUDIT, len(queries))).astype(int)
        truth = queries[pool] @ self.vectors.T >= least
        if own is not None:
            here = np.flatnonzero(own[pool] >= 0)
            truth[here, own[pool[here]]] = False
        counts = truth.sum(1)
        linked = np.flatnonzero(counts)
        any_, few = linked[:: max(1, len(linked) // AUDIT)][:AUDIT], np.flatnonzero((counts > 0) & (counts < FIRST_BEAM // 2))[:AUDIT]
        rows = np.linspace(0, n - 1, min(AUDIT, n)).astype(int)
        samples = [(queries[pool[any_]], truth[any_]), (queries[pool[few]], truth[few])]
        if self.vectors.shape[1] > 1:
            probes = _probes(self.vectors[rows], least + 1e-3)
            samples.append((probes, np.arange(n)[None, :] == rows[:, None]))
        width, self.recall = FIRST_BEAM, 1.0
        while True:
            self.recall = min([1.0, *(self._recall(x, wanted, least, width) for x, wanted in samples if len(x))])
            if self.recall >= RECALL or width >= n:
                return width
            width *= 2

    def _recall(self, queries: np.ndarray, wanted: np.ndarray, least: float, width: int) -> float:
        found = np.zeros(wanted.shape, bool)
        for q, r, _ in self.hits(queries, least, width):
            found[q, r] = True
        return float(((found & wanted).sum(1) / wanted.sum(1)).mean())

    def parts(self) -> list[bytes]:
        return [r.astype("<i4").tobytes() for r in self.rows] + [x.astype("<i4").tobytes() for x in self.links]

    @classmethod
    def load(cls, vectors: np.ndarray, parts: list[bytes]) -> Graph:
        self = cls.__new__(cls)
        self.vectors = vectors
        half = len(parts) // 2
        self.rows = [np.frombuffer(r, "<i4").astype(np.int64) for r in parts[:half]]
        self.links = [np.frombuffer(x, "<i4").reshape(len(r), -1) for x, r in zip(parts[half:], self.rows, strict=True)]
        return self


def _probes(rows: np.ndarray, cosine: float) -> np.ndarray:
    """For each unit row a unit vector at that cosine, in a direction of its own."""
    rng = np.random.Generator(np.random.PCG64(7))
    aside = rng.normal(size=rows.shape)
    aside -= (aside * rows).sum(1, keepdims=True) * rows
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-30)
    return (cosine * rows + (1 - cosine**2) ** 0.5 * aside).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that no square over- or underflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _blocks(batches):
    """One row for each batch and dimension: class numbers, copies and components of the vectors as they came, packed."""
    for batch in batches:
        size = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
        out = []
        for dim in np.unique(size):
            own = batch.filter(pa.array(size == dim))
            cid = own.column("cid").to_numpy().astype("<i8")
            out.append((int(dim), int(cid[0]), cid.tobytes(), own.column("n").to_numpy().astype("<i8").tobytes(), own.column("embedding").flatten().to_numpy().tobytes()))
        yield pa.RecordBatch.from_pylist([dict(zip(("dim", "block", "ids", "copies", "data"), x, strict=True)) for x in out], BLOCK)


BLOCK = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("copies", pa.binary()), ("data", pa.binary())])
GRAPHS = "dim int, shard int, ids binary, copies binary, data binary, parts array<binary>, width int, recall double"


def _runs(batches, *keys: str) -> Iterator[tuple[tuple, dict]]:
    """(key, row) for the rows of sorted batches; one batch is held at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            yield tuple(row[k].as_py() for k in keys), row


def _array(value: pa.Scalar, dtype: str) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype)


def _built(dtype: str, least: float):
    """Build the graph of each (dim, shard); its rows come one after the other."""

    def graph(key, ids, copies, data):
        ids, copies, data = (np.concatenate(x) for x in (ids, copies, data))
        order = np.argsort(ids)
        ids, copies, data = ids[order], copies[order], data.reshape(len(ids), key[0])[order]
        made = Graph(_unit(data).astype(np.float32))
        width = made.audited_width(made.vectors, least, np.arange(len(ids)))
        columns = [[key[0]], [key[1]], [ids.tobytes()], [copies.tobytes()], [data.tobytes()], [made.parts()], [width], [made.recall]]
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.int32(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["dim", "shard", "ids", "copies", "data", "parts", "width", "recall"])

    def run(batches):
        at, parts = None, ([], [], [])
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("dim", "shard")], 1)
            cut = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]))
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if hi == lo:
                    continue
                if at is not None and at != tuple(key[lo].tolist()):
                    yield graph(at, *parts)
                    parts = ([], [], [])
                at = tuple(key[lo].tolist())
                own = batch.slice(lo, hi - lo)
                for part, x in zip(parts, (own.column("cid"), own.column("n"), own.column("embedding").flatten()), strict=True):
                    part.append(x.to_numpy().copy())
        if at is not None:
            yield graph(at, *parts)

    return run


def _searched(dtype: str, least: float):
    """Stream the blocks of queries past the graph before them: links a class, and a spanning forest of the links."""

    def sent(a, b, links):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], ["a", "b", "links"])

    def forest(ids, parent):
        child = np.flatnonzero(parent != np.arange(len(parent)))
        return sent(ids[child], ids[parent[child]], np.zeros(len(child), np.int64))

    def run(batches):
        at = ids = graph = parent = None
        for key, row in _runs(batches, "dim", "shard", "slice"):
            if row["kind"].as_py() == 0:
                if at is not None:
                    yield forest(ids, parent)
                at, ids, copies = key, _array(row["ids"], "<i8"), _array(row["copies"], "<i8")
                data = _array(row["data"], dtype).reshape(len(ids), -1)
                graph = Graph.load(_unit(data).astype(np.float32), [p.as_py() for p in row["parts"]])
                parent, width = np.arange(len(ids)), row["width"].as_py()
                margin = 1e-5 + 4e-7 * data.shape[1]  # more than single precision errs by
                continue
            if at != key:
                continue
            own = _array(row["ids"], "<i8")
            exact = _unit(_array(row["data"], dtype).reshape(len(own), -1))
            links, anchor = np.zeros(len(own), np.int64), np.full(len(own), -1)
            for q, r, s in graph.hits(exact.astype(np.float32), least - margin, width):
                ok = own[q] != ids[r]
                doubt = np.flatnonzero(ok & (s < least + margin))
                for lo in range(0, len(doubt), 1 << 16):
                    d = doubt[lo : lo + (1 << 16)]
                    ok[d] = np.einsum("kd,kd->k", exact[q[d]], _unit(data[r[d]])) >= least
                q, r = q[ok], r[ok]
                links += np.bincount(q, copies[r], len(own)).astype(np.int64)
                anchor[q[::-1]] = np.where(anchor[q[::-1]] < 0, r[::-1], anchor[q[::-1]])
                merge(parent, anchor[q], r)
            some = np.flatnonzero(anchor >= 0)
            yield sent(own[some], ids[anchor[some]], links[some])
        if at is not None:
            yield forest(ids, parent)

    return run


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.9, shards: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_recall) for every row of vectors(vec_id, embedding).

    n_links counts the other rows with a cosine of at least least (equal vectors among them).  Vectors that are null, empty,
    zero or not finite throughout link with nothing; vectors of different lengths don't link.  Repeated rows are rows,
    and rows of one vec_id with different vectors have links and components of their own; a null vec_id links with nothing, and
    its component_id and kept are null.  audited_recall is the least recall that a shard's audit ended with.
    """
    spark = vectors.sparkSession
    tune(spark)
    e = F.col("embedding")
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    dtype, sql = ("<f4", "float") if single else ("<f8", "double")
    vectors = vectors.select("vec_id", F.transform(e, lambda v: v.cast(sql)).alias("embedding"))
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists(e, lambda v: v != 0), F.lit(False))
    some = vectors.filter(usable)
    alone = vectors.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast("double").alias("audited_recall"))
    classes = materialize(some.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("cid", F.monotonically_increasing_id()))
    total = classes.count()
    shards = shards or max(SHARDS, -(-total // SHARD_ROWS))
    slices = max(1, -(-total // SLICE_ROWS))

    def placed(df: DataFrame, parts: int, number) -> DataFrame:
        return df.repartitionById(parts, F.pmod(number + F.col("dim") - F.lit(1), F.lit(parts)).cast("int"))

    dealt = classes.select(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("cid"), F.lit(shards)).cast("int").alias("shard"), "cid", "n", "embedding")
    graphs = materialize(placed(dealt, shards, F.col("shard")).sortWithinPartitions("dim", "shard").mapInArrow(_built(dtype, least), GRAPHS))
    blocks = classes.select("cid", "n", "embedding").mapInArrow(_blocks, "dim int, block long, ids binary, copies binary, data binary")
    asked = blocks.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int").alias("slice"), F.lit(1).alias("kind"),
        "dim", "ids", "copies", "data", F.lit(None).cast("array<binary>").alias("parts"), F.lit(None).cast("int").alias("width"),
    )
    sides = graphs.drop("recall").withColumns({"slice": F.explode(F.sequence(F.lit(0), F.lit(slices - 1))), "kind": F.lit(0)}).unionByName(asked)
    streams = placed(sides, shards * slices, F.col("shard") * slices + F.col("slice")).sortWithinPartitions("dim", "shard", "slice", "kind")
    found = materialize(streams.mapInArrow(_searched(dtype, least), "a long, b long, links long"))
    recall = graphs.agg(F.min("recall")).first()[0]
    drop(graphs)
    comp = components(found.select("a", "b"))
    counts = found.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    known = materialize(
        classes.join(counts, "cid", "left").join(comp.withColumnRenamed("id", "cid"), "cid", "left")
        .select("embedding", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    )
    least_id = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = materialize(known.join(least_id, "component").select("embedding", "n_links", "component_id"))
    linked = some.join(known, "embedding").select("vec_id", "n_links", "component_id", F.lit(recall).cast("double").alias("audited_recall"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id")).select("vec_id", "n_links", "component_id", "kept", "audited_recall")


def op1_hnsw_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
