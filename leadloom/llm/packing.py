"""Filling containers of fixed capacity with items, by best fit and then swap-based local search.

Rows are spread by a hash over shards of about ``SHARD`` items, each packed for itself: a shard wastes at most a few containers'
rest against a packing of all rows together, and the work is linear in the number of shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.shared import cut_lineage

#: Items a shard holds on average.
SHARD = 8192
#: Capacities a table of settings may name.
MOST_SPECS = 1000


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A bin for each item: items from the largest, each into the fullest bin that has room. Room is looked up in a bit set."""
    bins = np.empty(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, count = 0, 0  # bit r of rooms: some bin has r left
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        above = rooms >> size
        if size and above:
            room = size + (above & -above).bit_length() - 1
            at = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        elif size:
            room, at = capacity, count
            count += 1
        else:  # items without size take no room: the first bin
            bins[i] = 0
            count = max(count, 1)
            continue
        bins[i] = at
        left = room - size
        if left:
            open_bins[left].append(at)
            rooms |= 1 << left
    return bins


def local_search(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Exchange items between underfull bins as long as the sum of squared fills grows.

    From the least filled bin on: one of its items moves to another bin, or is exchanged for a smaller one there, or two of its
    items are exchanged for one. Each step takes the exchange that gains most. The sum is a bounded integer, so the search ends;
    it empties bins because filling full bins fuller gains most.
    """
    bins = bins.copy()
    fill = np.bincount(bins, weights=sizes, minlength=int(bins.max(initial=-1)) + 1).astype(np.int64)
    real = np.flatnonzero(sizes > 0)
    improved = True
    while improved:
        improved = False
        under = np.flatnonzero((fill > 0) & (fill < capacity))
        if len(under) < 2:
            break
        item = real[np.isin(bins[real], under)]
        size, at = sizes[item].astype(np.int64), bins[item].copy()
        members: dict[int, list[int]] = {}
        for k, b in enumerate(at.tolist()):
            members.setdefault(b, []).append(k)
        for source in under[np.argsort(fill[under], kind="stable")].tolist():
            while members.get(source):
                own = sorted(members[source], key=lambda k: -size[k])
                f = int(fill[source])
                room = capacity - fill[at]
                best = (0, -1, (), -1)  # gain, target, leaving items, item that comes back
                target_fill = fill[under]
                for a in own:
                    s = int(size[a])
                    gain = np.where((target_fill + s <= capacity) & (under != source), 2 * s * (target_fill - f + s), 0)
                    t = int(np.argmax(gain))
                    if gain[t] > best[0]:
                        best = (int(gain[t]), int(under[t]), (a,), -1)
                leaving = [(a,) for a in own]
                if len(own) > 1:
                    seen = set()
                    for i in range(len(own)):
                        for j in range(i + 1, len(own)):
                            total = int(size[own[i]] + size[own[j]])
                            if total not in seen:
                                seen.add(total)
                                leaving.append((own[i], own[j]))
                for group in leaving:
                    d = int(size[list(group)].sum()) - size
                    gain = np.where((d > 0) & (d <= room) & (at != source), 2 * d * (fill[at] - f + d), 0)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (int(gain[k]), int(at[k]), group, k)
                gain, target, group, back = best
                if gain <= 0:
                    break
                improved = True
                for a in group:
                    members[source].remove(a)
                    members[target].append(a)
                    at[a] = target
                    fill[source] -= size[a]
                    fill[target] += size[a]
                if back >= 0:
                    members[target].remove(back)
                    members[source].append(back)
                    at[back] = source
                    fill[target] -= size[back]
                    fill[source] += size[back]
        bins[item] = at
    return bins


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bins 0, 1, ... for items of at most ``capacity``; items without size go to bin 0."""
    if not len(sizes):
        return np.empty(0, np.int64)
    bins = local_search(sizes, best_fit(sizes, capacity), capacity)
    used = np.unique(bins[sizes > 0])
    if not len(used):
        return np.zeros(len(sizes), np.int64)
    return np.where(sizes > 0, np.searchsorted(used, bins), 0)


def pack_items(items: DataFrame, specs: DataFrame, shard_items: int = SHARD) -> DataFrame:
    """(spec_id, container_id, doc_id, piece, first_token, n_tokens): every item in a container of every spec's capacity.

    items: doc_id, n_tokens. specs: spec_id, capacity. An item is cut only where it exceeds the capacity: into whole
    containers of its own and a rest that is packed like an item; ``piece`` counts from 0 and ``first_token`` is where the piece
    begins. Null sizes count as 0; items of size 0 are put, with n_tokens 0, into the first container of their shard. Rows with
    the same doc_id are items of their own. Specs without a positive capacity give no rows; empty tables an empty result.
    Hot keys don't matter: shards are drawn by a hash of the whole row and its number among equal ones, at equal size. More than
    ``MOST_SPECS`` capacities are refused.
    """
    # Equal rows are told apart by a number, so that many copies of a row don't fall into one shard; what a row's shard is depends
    # on nothing but the rows, so a rerun over other file splits gives the same containers.
    alike = items.groupBy("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens")).agg(F.count("*").alias("copies"))
    thousands = alike.select("doc_id", "n_tokens", "copies", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(copies - 1) div 1000"))).alias("k"))
    items = thousands.select("doc_id", "n_tokens", F.explode(F.sequence(F.col("k") * 1000, F.least(F.col("copies") - 1, F.col("k") * 1000 + 999))).alias("copy"))
    items = cut_lineage(items)
    shards = max(1, -(-items.count() // shard_items))
    specs = specs.filter("capacity > 0").select("spec_id", F.col("capacity").cast("bigint").alias("capacity"))
    few = specs.limit(MOST_SPECS + 1).collect()
    if len(few) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} capacities")
    each = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens", "copy"), F.lit(shards))).drop("copy")
    kinds = f"array<struct<spec_id:{specs.schema['spec_id'].dataType.simpleString()},capacity:bigint>>"
    settings = F.array(*[F.struct(F.lit(r.spec_id).alias("spec_id"), F.lit(r.capacity).alias("capacity")) for r in few]).cast(kinds)
    each = each.select("*", F.inline(settings))
    # Full pieces need no packing; the rest of each item does.
    full = each.filter("n_tokens > capacity").select(
        "*", F.explode(F.sequence(F.lit(0), (F.col("n_tokens") / F.col("capacity")).cast("int") - 1)).alias("piece")
    ).select("spec_id", "capacity", "shard", "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("n"))
    over = F.col("n_tokens") > F.col("capacity")
    rest = each.filter(~over | (F.col("n_tokens") % F.col("capacity") > 0)).select(
        "spec_id", "capacity", "shard", "doc_id",
        F.when(over, (F.col("n_tokens") / F.col("capacity")).cast("int")).otherwise(0).alias("piece"),
        F.when(over, F.col("n_tokens") - F.col("n_tokens") % F.col("capacity")).otherwise(0).alias("first_token"),
        F.when(over, F.col("n_tokens") % F.col("capacity")).otherwise(F.col("n_tokens")).alias("n"),
    )

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n", "doc_id", "piece"], ascending=False, kind="stable")
        sizes, capacity = part.n.to_numpy(np.int64), int(part.capacity.iloc[0])
        whole = sizes == capacity
        bins = np.empty(len(part), np.int64)
        bins[~whole] = pack(sizes[~whole], capacity)
        base = int(bins[~whole].max()) + 1 if (~whole).any() else 0
        bins[whole] = base + np.arange(int(whole.sum()))
        return pd.DataFrame({
            "spec_id": part.spec_id, "container_id": (int(part["shard"].iloc[0]) << 32) + bins, "doc_id": part.doc_id,
            "piece": part.piece, "first_token": part.first_token, "n_tokens": part.n,
        })

    key = items.schema["doc_id"].dataType.simpleString()
    kind = specs.schema["spec_id"].dataType.simpleString()
    out = f"spec_id {kind}, container_id bigint, doc_id {key}, piece int, first_token bigint, n_tokens bigint"
    return full.unionByName(rest).groupBy("spec_id", "shard").applyInPandas(run, out)
