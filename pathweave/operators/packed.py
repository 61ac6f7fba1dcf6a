"""The subgraph algebra of :mod:`pathweave.operators.subgraph` on subgraphs of one row each.

A row is ``query_id, roots``: each root (``id, next``) with all its paths as one tree, as
:func:`pathweave.plans.pattern.trees` makes it.  A row's nodes, edges and distances are worked out
where it is read, so that none of them is shuffled or written.  Rows are to be of bounded size;
larger subgraphs go through the operators on nodes and edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pathweave.operators.subgraph import BUDGET, COMPARISON_BUDGET, REGULATION_SLOTS, SHARED_LIMIT
from pathweave.schema import PROTECTED_CONSTRAINTS
from pathweave.session import ship_package

#: Bytes of rows unfolded at a time; a larger row is one piece of its own.
PIECE_BYTES = 4 << 20

#: Vertex type and edge type of each level of the trees; roots have no edge.
Levels = list[tuple[str, str | None]]


class Subgraphs:
    """The nodes and edges of a batch of trees, numbered through the batch.

    Nodes are in the order of their first place on the paths: of node i ``query`` is its row,
    ``ord`` its place in the row from 1, ``level`` the level where it is first.  Edges ``src``,
    ``dst`` with the level ``edge`` of their targets are a bag.
    """

    def __init__(self, roots: pa.ListArray):
        ids, parents, part = [], [], roots
        while part is not None:
            sizes = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, part = part.flatten(), None
            if pa.types.is_struct(flat.type):
                flat, part = flat.field("id"), flat.field("next")
                if ids:  # roots are not marked
                    flat = pc.if_else(part.is_valid(), pc.utf8_slice_codeunits(flat, 0, -1), flat)
            ids.append(flat)
            parents.append(np.repeat(np.arange(len(sizes)), sizes))
        # paths go down from the first child to the last: a tree's places are numbered so
        below, weights = np.zeros(len(ids[-1]), np.int64), []
        for k in range(len(ids) - 1, -1, -1):
            weights.insert(0, 1 + below)
            below = np.bincount(parents[k], weights[0], len(ids[k - 1]) if k else len(roots)).astype(np.int64)
        places, rows = [], []
        for k, (parent, weight) in enumerate(zip(parents, weights, strict=True)):
            before = np.cumsum(weight) - weight
            if k:
                first = np.searchsorted(parent, np.arange(len(ids[k - 1])))
                before = places[-1][parent] + 1 + before - before[np.minimum(first, len(before) - 1)][parent] if len(before) else before
            places.append(before)
            rows.append(rows[-1][parent] if k else parent)
        place, level = np.concatenate(places), np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        known = pa.concat_arrays(ids).dictionary_encode()
        code = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        key = np.empty(len(place), np.int64)
        key[place] = np.concatenate(rows) * len(known.dictionary) + code
        at = np.empty(len(place), np.int64)
        at[place] = np.arange(len(place))
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        order = np.argsort(first)
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        seen = at[first[order]]
        self.count, self.query, self.level = len(roots), np.concatenate(rows)[seen], level[seen]
        self.id = known.dictionary.take(pa.array(code[seen]))
        self.ord = np.arange(len(seen)) - np.searchsorted(self.query, self.query) + 1
        node = np.split(number[inverse[place]], np.cumsum([len(x) for x in ids])[:-1])
        self.root = node[0]
        self.src = np.concatenate([node[k - 1][parents[k]] for k in range(1, len(ids))])
        self.dst, self.edge = np.concatenate(node[1:]), level[len(node[0]) :]

    def distances(self, start: np.ndarray, depth: int | None = None) -> np.ndarray:
        """Each node's distance from the nodes ``start``, undirected; -1 where there is no way or
        it is longer than ``depth``."""
        found = np.full(len(self.query), -1)
        found[start] = 0
        ends = np.concatenate([self.src, self.dst])
        by = np.argsort(ends, kind="stable")
        other, first = np.concatenate([self.dst, self.src])[by], np.searchsorted(ends[by], np.arange(len(found) + 1))
        front, d = np.unique(start), 0
        while len(front) and (depth is None or d < depth):
            d += 1
            sizes = first[front + 1] - first[front]
            to = other[np.repeat(first[front] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            front = np.unique(to[found[to] < 0])
            found[front] = d
        return found

    def pruned(self, among: np.ndarray, distance: np.ndarray, levels: Levels, budget: int, regulation_slots: int) -> np.ndarray:
        """Which nodes a budget keeps of those ``among``, as :func:`subgraph.prune` does."""
        protected = np.array([e in PROTECTED_CONSTRAINTS for _, e in levels])[self.edge] & among[self.src] & among[self.dst]
        safe = np.zeros(len(among), bool)
        safe[self.src[protected]] = safe[self.dst[protected]] = True
        reg = np.array([t == "Regulation" for t, _ in levels])[self.level]
        count = lambda which: np.bincount(self.query[among & which], minlength=self.count)
        n, n_safe, n_reg, n_other = count(True), count(safe), count(~safe & reg), count(~safe & ~reg)
        free = budget - n_safe
        slots = np.minimum(np.minimum(np.maximum(0, regulation_slots - count(safe & reg)), n_reg), free)
        others = np.minimum(free - slots, n_other)
        place = self.places(self.query * 2 + reg, among & ~safe, distance)
        near = place <= np.where(reg, (free - others)[self.query], others[self.query])
        return among & ((n[self.query] <= budget) | safe | ((n_safe[self.query] < budget) & near))

    def places(self, group: np.ndarray, among: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """The place from 1 of each node ``among`` in its group, by distance (none last) and ``ord``."""
        nodes = np.flatnonzero(among)
        # numbers of nodes are in order
        order = nodes[np.lexsort((nodes, np.where(distance < 0, 1 << 30, distance)[nodes], group[nodes]))]
        place = np.zeros(len(among), np.int64)
        place[order] = np.arange(len(order)) - np.searchsorted(group[order], group[order]) + 1
        return place


def _each(rows: DataFrame, find: Callable[[Subgraphs], tuple[np.ndarray, dict[str, pa.Array]]], schema: str) -> DataFrame:
    """``query_id, id`` and further columns of the nodes that ``find`` names, for all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo = []
        for batch in batches:
            todo.append(batch)
            while todo:
                part = todo.pop()
                if part.nbytes > PIECE_BYTES and part.num_rows > 1:
                    half = part.num_rows // 2
                    todo += [part.slice(half), part.slice(0, half)]
                elif part.num_rows:
                    graphs = Subgraphs(part.column(1))
                    nodes, more = find(graphs)
                    at = pa.array(nodes)
                    columns = {"query_id": part.column(0).take(pa.array(graphs.query[nodes])), "id": graphs.id.take(at)} | {k: v.take(at) for k, v in more.items()}
                    yield pa.RecordBatch.from_pydict(columns)

    ship_package(rows.sparkSession)
    return rows.select("query_id", "roots").mapInArrow(run, "query_id string, id string, " + schema)


def _types(graphs: Subgraphs, levels: Levels) -> pa.Array:
    return pa.array([t for t, _ in levels]).take(pa.array(graphs.level))


def distances(rows: DataFrame, depth: int | None = None) -> DataFrame:
    """``query_id, id, distance`` from each row's roots, as :func:`subgraph.distances`."""

    def find(graphs: Subgraphs) -> tuple[np.ndarray, dict[str, pa.Array]]:
        far = graphs.distances(graphs.root, depth)
        return np.flatnonzero(far >= 0), {"distance": pa.array(far, pa.int64())}

    return _each(rows, find, "distance long")


def prune(rows: DataFrame, levels: Levels, budget: int = BUDGET, regulation_slots: int = REGULATION_SLOTS, depth: int | None = None) -> DataFrame:
    """``query_id, id, type, ord`` of the nodes that a budget keeps by distance from each row's
    roots, as :func:`subgraph.prune`."""

    def find(graphs: Subgraphs) -> tuple[np.ndarray, dict[str, pa.Array]]:
        stays = graphs.pruned(np.ones(len(graphs.query), bool), graphs.distances(graphs.root, depth), levels, budget, regulation_slots)
        return np.flatnonzero(stays), {"type": _types(graphs, levels), "ord": pa.array(graphs.ord, pa.int32())}

    return _each(rows, find, "type string, ord int")


def compare(rows: DataFrame, levels: Levels, side: Callable[[pa.Array], np.ndarray], budget: int = COMPARISON_BUDGET, shared_limit: int = SHARED_LIMIT, depth: int | None = None) -> DataFrame:
    """``query_id, id, type, compared`` of the nodes of two roots, as :func:`subgraph.compare`;
    ``side`` gives 1 or 2 for ids of roots."""

    def find(graphs: Subgraphs) -> tuple[np.ndarray, dict[str, pa.Array]]:
        sides = side(graphs.id.take(pa.array(graphs.root)))
        a, b = (graphs.distances(graphs.root[sides == k], depth) for k in (1, 2))
        a, b = (np.where(x < 0, 1 << 30, x) for x in (a, b))
        owner, near = np.where(a < b, 1, np.where(b < a, 2, 0)), np.minimum(a, b)
        kept = (owner == 0) & (graphs.places(graphs.query, owner == 0, near) <= shared_limit)
        for k in (1, 2):
            kept |= graphs.pruned(owner == k, near, levels, budget, REGULATION_SLOTS)
        return np.flatnonzero(kept), {"type": _types(graphs, levels), "compared": pa.array(["shared", "1", "2"]).take(pa.array(owner))}

    return _each(rows, find, "type string, compared string")
