"""A hierarchical index over 64-bit fingerprints in Gray order, and the links it finds.

Fingerprints are sorted by Gray rank, so that neighbours share long bit patterns. Each node of the index
holds the bits that all fingerprints below it share (a mask and a pattern); bits already held by a node's
parent are taken out. A search goes down from the top, adding up the differences to each node's own bits,
and leaves a node with its whole group as soon as the sum passes the limit.

Across the cluster, the top node of each task is a prefix of the Gray order, so its pattern is that
prefix. A fingerprint searches its own node, and those smaller ones whose pattern it meets within the
limit: every pair that links meets in exactly one task.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.forest import Forest

#: Fingerprints that a task's own node should hold; prefixes are as long as that asks for.
NODE_SIZE = 16_384
#: Bits of a prefix at least and at most, and further bits of a prefix that holds too many.
MIN_BITS, MAX_BITS, EXTRA_BITS = 6, 12, 10
#: Members of a lowest node, children of a node above, and partial searches held at once.
LEAF, FANOUT, HELD = 16, 8, 1 << 20


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The rank of each uint64 code in the reflected Gray order."""
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """The index of a set of codes; ``order`` sorts them by Gray rank."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        self.levels = []  # from the lowest up: starts, mask, pattern
        low, high = self.codes, self.codes  # AND and OR of what is below
        step = LEAF
        while len(low) > 1 or not self.levels:
            starts = np.arange(0, len(low), step)
            low = np.bitwise_and.reduceat(low, starts)
            high = np.bitwise_or.reduceat(high, starts)
            self.levels.append((starts, ~(low ^ high), low))
            step = FANOUT
        # A node keeps only the bits that its parent does not hold.
        self.own = []
        for level, (_, mask, _) in enumerate(self.levels):
            if level + 1 < len(self.levels):
                above = self.levels[level + 1][1][np.arange(len(mask)) // FANOUT]
                mask = mask & ~above
            self.own.append(mask)

    def uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """For each level, the label that all of a node's members have, or -1."""
        out, low, high = [], label[self.order], label[self.order]
        for starts, _, _ in self.levels:
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            out.append(np.where(low == high, low, -1))
        return out

    def search(self, queries: np.ndarray, limit: int, forest: Forest, rows: np.ndarray, members: np.ndarray):
        """Join in ``forest`` every query row with every member within ``limit`` differing bits.

        ``rows`` and ``members`` are the forest rows of queries and codes. A group that is already
        in a query's tree is passed over, so a dense cluster costs its size, not its square.
        """
        width = 4096
        done = 0
        while done < len(queries):
            part = slice(done, done + width)
            if self._search(queries[part], limit, forest, rows[part], members) or width == 1:
                done += width
                width = min(4096, width * 2)
            else:
                width = max(1, width // 8)

    def _search(self, queries, limit, forest, rows, members) -> bool:
        """False, and nothing joined, if more than ``HELD`` partial searches came up at once."""
        known = forest.label[members]
        same = self.uniform(known)
        top = len(self.levels) - 1
        query = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        sum_ = np.zeros(len(queries), np.uint8)
        may_stop = len(queries) > 1
        for level in range(top, -1, -1):
            if level < top:
                count = len(self.levels[level][0])
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                query, sum_ = np.repeat(query, FANOUT), np.repeat(sum_, FANOUT)
                there = node < count
                query, node, sum_ = query[there], node[there], sum_[there]
            own, pattern = self.own[level], self.levels[level][2]
            sum_ = sum_ + np.bitwise_count((queries[query] ^ pattern[node]) & own[node])
            keep = (sum_ <= limit) & (same[level][node] != forest.label[rows[query]])
            query, node, sum_ = query[keep], node[keep], sum_[keep]
            if may_stop and len(query) * LEAF > HELD:
                return False
        for at in range(0, len(query), HELD // LEAF):
            q = np.repeat(query[at : at + HELD // LEAF], LEAF)
            m = (node[at : at + HELD // LEAF, None] * LEAF + np.arange(LEAF)).ravel()
            there = m < len(self.codes)
            q, m = q[there], m[there]
            near = np.bitwise_count(queries[q] ^ self.codes[m]) <= limit
            q, m = q[near], self.order[m[near]]
            forest.link(rows[q], members[m])
        return True


def _flips(bits: int, limit: int) -> list[int]:
    """All patterns of ``bits`` bits with at most ``limit`` ones."""
    return [sum(1 << i for i in c) for n in range(min(bits, limit) + 1) for c in combinations(range(bits), n)]


def hamming_links(prints: DataFrame, limit: int = 3, node_size: int = NODE_SIZE) -> DataFrame:
    """Edges ``a, b`` whose components are those of all pairs within ``limit`` differing bits.

    ``prints`` holds distinct ``code long`` and the ``node long`` that stands for each. The driver gets
    64 bit counts and at most 2^MAX_BITS prefix counts, however large the table is. Each task emits a
    forest of its links, so edges stay below rows even where all of a group link with each other.
    """
    ones = [F.sum(F.shiftrightunsigned("code", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)]
    total, *ones = prints.agg(F.count("*"), *ones).first()
    # Codes are compared with their most even bits first, so that prefixes split the table evenly.
    even = sorted(range(64), key=lambda i: (abs(2 * (ones[i] or 0) - total), i))
    bits = MIN_BITS
    while bits < MAX_BITS and total > node_size << bits:
        bits += 1

    def permuted(code: np.ndarray) -> np.ndarray:
        out = np.zeros(len(code), np.uint64)
        for place, bit in enumerate(even):
            out |= (code >> np.uint64(bit) & np.uint64(1)) << np.uint64(63 - place)
        return out

    def arrange(batches):
        for batch in batches:
            code = permuted(batch.column(0).to_numpy().view(np.uint64))
            prefix = (gray_rank(code) >> np.uint64(64 - bits)).astype(np.int32)
            yield pa.record_batch(
                [pa.array(code.view(np.int64)), batch.column(1), pa.array(prefix)], names=["code", "node", "prefix"]
            )

    ranked = prints.select("code", "node").mapInArrow(arrange, "code long, node long, prefix int")
    extra = np.zeros(1 << bits, np.int64)  # further bits by prefix code
    for prefix, count in ranked.groupBy("prefix").count().where(F.col("count") > 2 * node_size).collect():
        further = int(np.ceil(np.log2(count / node_size)))
        extra[prefix ^ (prefix >> 1)] = min(EXTRA_BITS, further)

    def rank_of(prefix, sub):
        """A number for a node: prefixes, then their parts, in one order for all tasks."""
        return prefix << EXTRA_BITS | sub

    def deal(batches):
        flips = np.array(_flips(bits, limit))
        for batch in batches:
            code = batch.column(0).to_numpy().view(np.uint64)
            name = batch.column(1).to_numpy()
            prefix = (code >> np.uint64(64 - bits)).astype(np.int64)
            rest = (code >> np.uint64(64 - bits - EXTRA_BITS)).astype(np.int64) & ((1 << EXTRA_BITS) - 1)
            own = rank_of(prefix, rest >> (EXTRA_BITS - extra[prefix]))
            parts = [(np.arange(len(code)), own)]
            for flip in flips:
                target = prefix ^ flip
                left = limit - int(flip).bit_count()
                for more in np.unique(extra[target]):
                    row = np.flatnonzero(extra[target] == more)
                    sub = rest[row] >> (EXTRA_BITS - more)
                    for turn in _flips(int(more), left):
                        to = rank_of(target[row], sub ^ turn)
                        smaller = to < own[row]
                        parts.append((row[smaller], to[smaller]))
            for row, to in parts:
                if len(row):
                    yield pa.record_batch(
                        [pa.array(to), pa.array(code[row].view(np.int64)), pa.array(name[row]), pa.array(to == own[row])],
                        names=["at", "code", "node", "member"],
                    )

    def search(table: pa.Table) -> pa.Table:
        code = table.column("code").to_numpy().view(np.uint64)
        name = table.column("node").to_numpy()
        member = table.column("member").to_numpy(zero_copy_only=False)
        forest = Forest(len(code))
        rows = np.flatnonzero(member)
        if len(rows):
            index = GrayIndex(code[rows])
            index.search(code[rows][index.order], limit, forest, rows[index.order], rows)
            others = np.flatnonzero(~member)
            others = others[np.argsort(gray_rank(code[others]), kind="stable")]
            index.search(code[others], limit, forest, others, rows)
        a, b = forest.edges()
        return pa.table({"a": name[a], "b": name[b]})

    dealt = ranked.mapInArrow(deal, "at long, code long, node long, member boolean")
    return dealt.groupBy("at").applyInArrow(search, "a long, b long")
