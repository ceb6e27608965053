"""Communities of a weighted graph: distributed modularity optimisation, and the search for the resolution that gives a wanted number of them.

The steps are those of Leiden's method: nodes move to the neighbouring community of the largest gain until few move, communities are refined into well-connected
parts, and the parts become the nodes of a smaller graph, on which it goes on. Several resolutions go through the same jobs, as a column. A graph that fits one block is finished there.

Moves run in blocks of bounded size, one task each, node after node inside a block. A block holds whole communities (a community above the bound is dealt over several), so
a node knows its own community as it is; what lies in other blocks is known as it was when the round began. Into a community with members elsewhere a node
may only move if that has a lower number (in even rounds) or a higher one (in odd rounds), so that two nodes can't swap places for ever. No task and no driver holds the graph.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ratio
from ..session import Tables

#: Nodes of a block, about, and of a community before it is dealt over several blocks.
BLOCK_NODES = 50_000
#: A graph of at most a block's nodes and so many edges a node on average is finished in one task.
EDGES_PER_NODE = 50
MAX_ROUNDS, MAX_LEVELS, MAX_SWEEPS = 12, 20, 30
#: A level has settled when at most this share of the nodes moved in a round.
SETTLED = 0.001
#: Gains below this count as none.
LEAST_GAIN = 1e-10
#: Nodes of a block, at most, and the share of moves at which a level has settled, where a graph is made coarse.
COARSE_NODES, COARSE_SETTLED = 5_000, 0.02


def undirected(edges: DataFrame) -> DataFrame:
    """``(src, dst, w)`` both ways, once each: an edge that is given in both directions or repeatedly counts with its largest weight. Loops, null ends and weights that aren't positive are left out."""
    weight = F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)
    one = edges.select("src", "dst", weight.alias("w")).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst AND w > 0 AND NOT isnan(w)")
    one = one.groupBy(F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst")).agg(F.max("w").alias("w"))
    return one.union(one.select("dst", "src", "w"))


def _joined(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that shuffles: there are hundreds over the rounds, and tables of nodes just small enough to be broadcast would all pass through the driver."""
    return a.join(b.hint("merge"), on, how)


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row ``(modularity)``: of ``labels(node, community)`` on the graph ``edges(src, dst[, w])``; nodes without a label are left out with their edges. No edges: null."""
    both = undirected(edges).join(labels.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    per = both.groupBy("a").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), F.col("w")).otherwise(0.0)).alias("inside"))
    total = F.sum("k")
    return per.agg((ratio(F.sum("inside"), total) - resolution * ratio(F.sum(F.col("k") * F.col("k")), total * total)).alias("modularity"))


class _Block:
    """The edges of a block's nodes, sorted by node; ends outside the block are known by their community only."""

    def __init__(self, frame: pd.DataFrame):
        frame = frame.sort_values(["src", "dst"], kind="stable")
        self.nodes, first, at = np.unique(frame["src"].to_numpy(), return_index=True, return_inverse=True)
        self.start = [*first.tolist(), len(frame)]
        dst = frame["dst"].to_numpy()
        place = np.minimum(np.searchsorted(self.nodes, dst), len(self.nodes) - 1)
        self.end = np.where(self.nodes[place] == dst, place, -1).tolist()
        self.weight, self.degree = frame["w"].tolist(), frame["sk"].to_numpy()[first].tolist()
        own, other = frame["sc"].to_numpy(), frame["dc"].to_numpy()
        self.labels, codes = np.unique(np.concatenate([own, other]), return_inverse=True)
        self.community, self.beyond = codes[: len(own)][first].tolist(), codes[len(own) :].tolist()
        self.total = np.zeros(len(self.labels))
        self.total[codes] = np.concatenate([frame["stot"].to_numpy(), frame["dtot"].to_numpy()])
        self.total = self.total.tolist()
        size = np.zeros(len(self.labels), np.int64)
        size[codes[: len(own)]] = frame["sn"].to_numpy()
        self.whole = (np.bincount(codes[: len(own)][first], minlength=len(self.labels)) == size).tolist()

    def order(self, seed: int) -> list[int]:
        return np.random.default_rng([seed, len(self.nodes)]).permutation(len(self.nodes)).tolist()


def _moved(block: _Block, resolution: float, total: float, turn: int, seed: int) -> np.ndarray:
    """The communities after sweeps over a block's nodes until none moves."""
    community, tot, scale = block.community, block.total, resolution / total
    for sweep in range(MAX_SWEEPS):
        moves = 0
        for i in block.order(seed + sweep):
            own, k, weights = community[i], block.degree[i], {}
            for e in range(block.start[i], block.start[i + 1]):
                end = block.end[e]
                if end != i:
                    c = community[end] if end >= 0 else block.beyond[e]
                    weights[c] = weights.get(c, 0.0) + block.weight[e]
            tot[own] -= k
            best, to = weights.get(own, 0.0) - scale * k * tot[own], own
            for c, w in weights.items():
                gain = w - scale * k * tot[c]
                if gain > best + LEAST_GAIN and (block.whole[c] or (c < own) == (turn % 2 == 0)):
                    best, to = gain, c
            tot[to] += k
            if to != own:
                community[i], moves = to, moves + 1
        if not moves:
            break
    return block.labels[community]


def _parts(block: _Block, resolution: float, total: float, seed: int) -> np.ndarray:
    """Well-connected parts of the communities of a block (whose edges all lie inside communities), each named by one of its nodes."""
    n, scale = len(block.nodes), resolution / total
    part, size, degree = list(range(n)), [1] * n, list(block.degree)
    outward = [sum(block.weight[e] for e in range(block.start[i], block.start[i + 1]) if block.end[e] != i) for i in range(n)]
    whole = [block.total[c] for c in block.community]

    def connected(p: int, i: int) -> bool:
        return outward[p] >= scale * degree[p] * (whole[i] - degree[p]) - LEAST_GAIN

    for i in block.order(seed):
        if size[part[i]] > 1 or part[i] != i or not connected(i, i):
            continue
        weights: dict[int, float] = {}
        for e in range(block.start[i], block.start[i + 1]):
            end = block.end[e]
            if end >= 0 and end != i:
                weights[part[end]] = weights.get(part[end], 0.0) + block.weight[e]
        best, to = 0.0, i
        for p, w in weights.items():
            gain = w - scale * block.degree[i] * degree[p]
            if gain > best + LEAST_GAIN and connected(p, i):
                best, to = gain, p
        if to != i:
            part[i] = to
            size[to] += 1
            size[i] = 0
            degree[to] += block.degree[i]
            outward[to] += outward[i] - 2 * weights[to]
    return block.nodes[part]


def _finished(block: pd.DataFrame, resolution: float, total: float, seed: int) -> pd.DataFrame:
    """``(node, label)`` of a small graph, level after level; ``block(src, dst, w, sc, dc)`` with the communities to start from."""
    edges = block
    at = pd.Series(np.unique(edges["src"].to_numpy()), name="at")
    nodes = at.to_numpy()
    for level in range(MAX_LEVELS):
        community = edges.groupby("src")["sc"].first()
        k = edges.groupby("src")["w"].sum()
        for step in ("move", "part"):
            tot, n = k.groupby(community).sum(), community.groupby(community).size()
            known = edges.assign(sk=edges["src"].map(k), sc=edges["src"].map(community), dc=edges["dst"].map(community))
            known = known.assign(stot=known["sc"].map(tot), sn=known["sc"].map(n), dtot=known["dc"].map(tot))
            if step == "move":
                community = pd.Series(_moved(_Block(known), resolution, total, 0, seed + 1000 * level), index=community.index)
        inner = known[known["sc"] == known["dc"]]
        part = pd.Series(community.index, index=community.index)
        if len(inner):
            own = _Block(inner)
            part[own.nodes] = _parts(own, resolution, total, seed + level)
        if part.nunique() == len(part):
            return pd.DataFrame({"node": nodes, "label": community[at].to_numpy()})
        at = at.map(part)
        start = community.groupby(part).min()
        edges = edges.assign(src=edges["src"].map(part), dst=edges["dst"].map(part)).groupby(["src", "dst"], as_index=False)["w"].sum()
        edges = edges.assign(sc=edges["src"].map(start), dc=edges["dst"].map(start))
    raise RuntimeError(f"communities did not settle in {MAX_LEVELS} levels")


def _blocked(tables: Tables, graph: DataFrame, state: DataFrame, block_nodes: int) -> DataFrame:
    """The edges with what both ends know, and the block of the first; ``state(resolution, node, community, k)``."""
    keys = ["resolution", "community"]
    known = _joined(state, state.groupBy(*keys).agg(F.sum("k").alias("tot"), F.count("*").alias("n")), keys)
    nodes = state.groupBy("resolution").agg(F.ceil(F.count("*") / block_nodes).alias("blocks"))
    known = known.join(F.broadcast(nodes), "resolution")  # a row for each resolution
    block = F.pmod(F.xxhash64("community", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / block_nodes))), F.col("blocks"))
    known = tables.keep(known.withColumn("block", block))  # read twice
    src = known.select("resolution", F.col("node").alias("src"), F.col("community").alias("sc"), F.col("k").alias("sk"), F.col("tot").alias("stot"), F.col("n").alias("sn"), "block")
    dst = known.select("resolution", F.col("node").alias("dst"), F.col("community").alias("dc"), F.col("tot").alias("dtot"))
    return _joined(_joined(graph, src, ["resolution", "src"]), dst, ["resolution", "dst"])


_LABELS = "resolution double, node long, label long"


def _on_blocks(step, total: float, *more):
    """``step(block, resolution, total, *more)``, a label for each of its nodes, for ``applyInPandas``."""

    def apply(key, frame: pd.DataFrame) -> pd.DataFrame:
        block = _Block(frame)
        return pd.DataFrame({"resolution": key[0], "node": block.nodes, "label": step(block, key[0], total, *more)})

    return apply


def _to_the_end(total: float, seed: int):
    def apply(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[["src", "dst", "w", "sc", "dc"]].sort_values(["src", "dst"], kind="stable")
        return _finished(frame, key[0], total, seed).assign(resolution=key[0])[["resolution", "node", "label"]]

    return apply


def _settled(tables: Tables, graph: DataFrame, labels: DataFrame, total: float, seed: int, block_nodes: int, *, coarse: bool = False):
    """``(resolution, node, at, community)``: the communities of ``graph(resolution, src, dst, w)``, level after level; ``labels(resolution, node, at)`` says at which of its nodes an original one is.

    With ``coarse`` it ends with ``(graph, labels)`` as soon as the parts make a graph that fits one block (or join no more), in smaller blocks and fewer rounds: what comes after begins from its nodes, and no community is chosen.
    """
    fits, settled = block_nodes, SETTLED
    if coarse:
        block_nodes, settled = min(block_nodes, COARSE_NODES), COARSE_SETTLED
    start = labels.select("resolution", F.col("at").alias("node"), F.col("at").alias("community"))
    for level in range(MAX_LEVELS):
        sizes = graph.groupBy("resolution").agg(F.countDistinct("src").alias("n"), F.count("*").alias("edges")).agg(F.max("n"), F.max("edges")).first()
        if sizes[0] <= fits and sizes[1] <= fits * EDGES_PER_NODE:
            if coarse:
                return graph, labels
            ends = [start.select("resolution", F.col("node").alias(end), F.col("community").alias(c)) for end, c in (("src", "sc"), ("dst", "dc"))]
            known = _joined(_joined(graph, ends[0], ["resolution", "src"]), ends[1], ["resolution", "dst"])
            done = known.groupBy("resolution").applyInPandas(_to_the_end(total, seed + 7919 * level), _LABELS)
            labels = _joined(labels, done.select("resolution", F.col("node").alias("at"), F.col("label").alias("community")), ["resolution", "at"])
            return labels
        degree = graph.groupBy("resolution", F.col("src").alias("node")).agg(F.sum("w").alias("k"))
        state = tables.keep(_joined(start, degree, ["resolution", "node"]))
        counts = {r["resolution"]: r["n"] for r in state.groupBy("resolution").agg(F.count("*").alias("n")).collect()}  # a row for each resolution
        for turn in range(MAX_ROUNDS):
            moved = _blocked(tables, graph, state, block_nodes).groupBy("resolution", "block").applyInPandas(_on_blocks(_moved, total, turn, seed + 1000 * level + 100 * turn), _LABELS)
            after = tables.keep(_joined(state, moved, ["resolution", "node"]).select("resolution", "node", F.col("label").alias("community"), "k", (F.col("label") != F.col("community")).alias("new")))
            changed = after.agg(F.count(F.when(F.col("new"), 1))).first()[0]
            state = after.drop("new")
            if changed <= settled * sum(counts.values()) or max(counts.values()) <= block_nodes:
                break
        parts = _blocked(tables, graph, state, block_nodes).where("sc = dc").groupBy("resolution", "block").applyInPandas(_on_blocks(_parts, total, seed + level), _LABELS)
        joined = _joined(state, parts, ["resolution", "node"], "left").select("resolution", "node", "community", F.coalesce("label", "node").alias("part"))
        joined = tables.keep(joined)
        left = joined.agg(F.countDistinct("resolution", "part")).first()[0]
        if left == sum(counts.values()):  # nothing joins any more
            return (graph, labels) if coarse else _joined(labels, joined.select("resolution", F.col("node").alias("at"), "community"), ["resolution", "at"])
        into = joined.select("resolution", F.col("node").alias("at"), "part")
        labels = tables.keep(_joined(labels, into, ["resolution", "at"]).select("resolution", "node", F.col("part").alias("at")))
        graph = _joined(_joined(graph, into.withColumnsRenamed({"at": "src", "part": "a"}), ["resolution", "src"]), into.withColumnsRenamed({"at": "dst", "part": "b"}), ["resolution", "dst"])
        graph = tables.keep(graph.groupBy("resolution", F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
        start = joined.groupBy("resolution", F.col("part").alias("node")).agg(F.min("community").alias("community"))
    raise RuntimeError(f"communities did not settle in {MAX_LEVELS} levels")


def _named(labels: DataFrame) -> DataFrame:
    """``(resolution, node, community)``, a community named by its least node."""
    least = labels.groupBy("resolution", "community").agg(F.min("node").alias("least"))
    return _joined(labels, least, ["resolution", "community"]).select("resolution", "node", F.col("least").alias("community"))


def communities(edges: DataFrame, resolutions: list[float] | float = 1.0, *, nodes: DataFrame | None = None, seed: int = 0, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """``(resolution, node, community)`` of the graph ``edges(src, dst[, w])`` (see :func:`undirected`), a community named by its least node.

    Nodes are the ends of edges; ``nodes(node)`` may add others, each a community of its own. The result depends on the seed, and beyond ``block_nodes`` nodes on how these fall into
    blocks, never on the order of the rows. No edges and no nodes: no rows.
    """
    wanted = sorted({float(r) for r in (resolutions if isinstance(resolutions, (list, tuple)) else [resolutions])})
    tables = Tables(edges.sparkSession)
    flat = tables.keep(undirected(edges))
    total = flat.agg(F.sum("w")).first()[0]
    every = F.explode(F.array(*(F.lit(r) for r in wanted))).alias("resolution")
    alone = None if nodes is None else nodes.select(F.col("node").cast("long").alias("node")).where("node IS NOT NULL").distinct()
    if total is None:
        empty = flat.select(F.lit(0.0).alias("resolution"), F.col("src").alias("node"), F.col("src").alias("community"))
        return empty if alone is None else alone.select(every, "node", F.col("node").alias("community"))
    graph = flat.select(every, "src", "dst", "w")
    labels = flat.select("src").distinct().select(every, F.col("src").alias("node"), F.col("src").alias("at"))
    labels = _settled(tables, graph, labels, total, seed, block_nodes)
    out = _named(labels)
    if alone is not None:
        missing = _joined(alone, flat.select(F.col("src").alias("node")).distinct(), ["node"], "left_anti")
        out = out.unionByName(missing.select(every, "node", F.col("node").alias("community")))
    return tables.result(out)


def communities_of_count(edges: DataFrame, target: int, *, nodes: DataFrame | None = None, lowest: float = 0.05, highest: float = 10.0, probes: int = 5, passes: int = 6, seed: int = 0, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """``(resolution, node, community)`` at a resolution that gives ``target`` communities, or the nearest number found.

    Each pass tries ``probes`` resolutions inside the bracket at once, at equal ratios, and keeps the gap in which the number passes the target: a bisection with more
    than two ways. Of equally near ones the lowest resolution counts. A graph beyond ``block_nodes`` is made coarse once: its well-connected parts at the highest resolution, which those of lower
    ones consist of, become the nodes that every pass begins with, all of them and all edges. Only numbers of communities come to the driver.
    """
    tables = Tables(edges.sparkSession)
    flat = tables.keep(undirected(edges))
    total = flat.agg(F.sum("w")).first()[0]
    if total is None:
        return communities(edges, lowest, nodes=nodes)
    each = F.lit(float(highest)).alias("resolution")
    ends = flat.select(F.col("src").alias("node")).distinct()
    graph, at = _settled(tables, flat.select(each, "src", "dst", "w"), ends.select(each, "node", F.col("node").alias("at")), total, seed, block_nodes, coarse=True)
    graph, at = tables.keep(graph.drop("resolution")), tables.keep(at.select("node", "at"))
    alone = None if nodes is None else tables.keep(_joined(nodes.select(F.col("node").cast("long").alias("node")).where("node IS NOT NULL").distinct(), ends, ["node"], "left_anti"))
    others = 0 if alone is None else alone.count()
    low, high, best = lowest, highest, None
    for _ in range(passes):
        every = F.explode(F.array(*(F.lit(low * (high / low) ** (i / (probes + 1))) for i in range(1, probes + 1)))).alias("resolution")
        found = _settled(tables, graph.select(every, "src", "dst", "w"), at.select("at").distinct().select(every, F.col("at").alias("node"), "at"), total, seed, block_nodes)
        found = tables.keep(found.select("resolution", "at", "community"))
        counts = sorted((r["resolution"], r["n"] + others) for r in found.groupBy("resolution").agg(F.countDistinct("community").alias("n")).collect())
        for resolution, n in counts:
            if best is None or (abs(n - target), resolution) < best[:2]:
                best = (abs(n - target), resolution, found)
        if best[0] == 0:
            break
        low = max([r for r, n in counts if n < target], default=low)
        high = min([r for r, n in counts if n > target and r > low], default=high)
    out = _named(_joined(at, best[2].where(F.col("resolution") == best[1]), ["at"]))
    if alone is not None:
        out = out.unionByName(alone.select(F.lit(best[1]).alias("resolution"), "node", F.col("node").alias("community")))
    return tables.result(out)
