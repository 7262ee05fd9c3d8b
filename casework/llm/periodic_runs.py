"""Periodic runs of words, found in a grammar of the text.

Re-Pair replaces pairs of symbols that repeat by new symbols, round by round, until none repeats: each new
symbol is a rule that derives the same words wherever it stands. A run that lies in what a rule derives, but
in neither of its two sides, crosses the rule's boundary; that is worked out once for each rule and
translated to all places that derive it. What Re-Pair leaves is joined two by two, and the boundaries of
those joins are searched in the same way. Intervals of one period that overlap are merged into maximal runs.
"""

from __future__ import annotations

from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the documents whose grammar is made at once (a longer document is a batch of its own), and pairs of
#: boundary and period that are looked at at once.
WORDS_AT_ONCE, LOOKED_AT = 1 << 18, 1 << 20
#: A run repeats its period LEAST_TIMES and has LEAST_WORDS at least.
LEAST_TIMES, LEAST_WORDS = 4, 6
#: Prime of the hashes that find squares; what they find is compared word by word.
PRIME, BASE = (1 << 31) - 1, 911_382_323


def repair(words: np.ndarray, owner: np.ndarray) -> tuple[list[tuple], tuple]:
    """The places of all rules, and what is left: ``[(rule, start, middle, end)]`` by round, and ``(start, end, owner)``.

    ``words`` are word ids that no two owners share, in the order of their owners. In each round every pair
    that is commoner than its neighbours is replaced wherever it stands, from left to right where it overlaps
    itself; pairs that would be replaced once only wait. Rules are numbered in the order they are made.
    """
    symbol, start = words.astype(np.int64), np.arange(len(words))
    end = start + 1
    fresh = int(symbol.max(initial=-1)) + 1
    rounds = []
    names = count()
    # A pair can repeat only inside one owner, and what has no pair that repeats is left as it is.
    left = []
    while len(symbol) > 1:
        pair = symbol[:-1] * fresh + symbol[1:] if fresh < 1 << 31 else _paired(symbol)
        pair = np.where(owner[:-1] == owner[1:], pair, -1)
        kinds, rank = np.unique(pair, return_inverse=True)
        # The same pair at adjacent places overlaps itself: every second place of such a stretch counts.
        at = np.arange(len(pair))
        begins = np.concatenate([[True], pair[1:] != pair[:-1]])
        apart = (at - np.maximum.accumulate(np.where(begins, at, 0))) % 2 == 0
        times = np.bincount(rank[apart], minlength=len(kinds))
        # Commoner pairs first; the number of the pair parts equals.
        prior = np.where((pair >= 0) & (times[rank] > 1), times[rank] * (len(kinds) + 1) + rank, -1)
        before = np.concatenate([[-1], np.where(begins[1:], prior[:-1], -1)])
        after = np.concatenate([np.where(begins[1:], prior[1:], -1), [-1]])
        taken = (prior >= 0) & apart & (prior > before) & (prior > after)
        taken &= np.bincount(rank[taken], minlength=len(kinds))[rank] > 1
        place = np.flatnonzero(taken)
        if not len(place):
            break
        kinds, kind = np.unique(rank[place], return_inverse=True)
        name = np.array([next(names) for _ in kinds])
        rounds.append((name[kind], start[place], end[place], end[place + 1]))
        symbol[place] = fresh + kind
        fresh += len(kinds)
        end[place] = end[place + 1]
        kept = np.ones(len(symbol), bool)
        kept[place + 1] = False
        symbol, start, end, owner = symbol[kept], start[kept], end[kept], owner[kept]
        # The commonest pair of an owner is always replaced, so one without a new symbol has none that repeats.
        changed = np.unique(owner[symbol >= fresh - len(kinds)])
        waits = np.isin(owner, changed)
        left.append((start[~waits], end[~waits], owner[~waits]))
        symbol, start, end, owner = symbol[waits], start[waits], end[waits], owner[waits]
    left.append((start, end, owner))
    start, end, owner = (np.concatenate(x) for x in zip(*left, strict=True))
    order = np.argsort(start, kind="stable")
    return rounds, (start[order], end[order], owner[order])


def _paired(symbol: np.ndarray) -> np.ndarray:
    """Numbers of adjacent pairs where the product of two symbols could pass 64 bits."""
    _, dense = np.unique(symbol, return_inverse=True)
    return dense[:-1] * (int(dense.max()) + 1) + dense[1:]


def _joins(start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> list[tuple]:
    """Start, middle and end of the joins, two by two in levels, of what Re-Pair leaves of each owner."""
    found = []
    while len(start) > 1:
        begins = np.concatenate([[True], owner[1:] != owner[:-1]])
        at = np.arange(len(start))
        offset = at - np.maximum.accumulate(np.where(begins, at, 0))
        first = np.flatnonzero((offset[:-1] % 2 == 0) & (owner[1:] == owner[:-1]))
        if not len(first):
            break
        found.append((start[first], end[first], end[first + 1]))
        end = end.copy()
        end[first] = end[first + 1]
        kept = np.ones(len(start), bool)
        kept[first + 1] = False
        start, end, owner = start[kept], end[kept], owner[kept]
    return found


def _powers(n: int) -> np.ndarray:
    """BASE to the powers 0 to n, modulo PRIME."""
    out = np.ones(n + 1, np.int64)
    known, power = 1, BASE
    while known <= n:
        more = min(known, n + 1 - known)
        out[known : known + more] = out[:more] * power % PRIME
        power = power * power % PRIME
        known += more
    return out


class Squares:
    """Tells where a text has squares (a part twice in a row), by hashes of its prefixes."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.power = _powers(len(words))
        mixed = (words * 2_654_435_761 + 12_345) % PRIME
        self.sums = np.concatenate([[0], np.cumsum(mixed * self.power[:-1] % PRIME)]) if len(words) else np.zeros(1, np.int64)

    def at(self, place: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Which squares of ``2 * period`` words start at ``place``; unequal parts may pass as equal, never the other way."""
        ok = np.flatnonzero(self.words[place] == self.words[place + period])
        ok = ok[self.words[place[ok] + period[ok] - 1] == self.words[place[ok] + 2 * period[ok] - 1]]
        a, q = place[ok], period[ok]
        first = (self.sums[a + q] - self.sums[a]) % PRIME
        second = (self.sums[a + 2 * q] - self.sums[a + q]) % PRIME
        return ok[first * self.power[q] % PRIME == second]


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading words two arrays share."""
    n, at, size = min(len(a), len(b)), 0, 32
    while at < n:
        stop = min(n, at + size)
        differ = a[at:stop] != b[at:stop]
        if differ.any():
            return at + int(differ.argmax())
        at, size = stop, size * 4
    return n


def _primitive(part: np.ndarray) -> bool:
    """Whether a part is no shorter part repeated."""
    n = len(part)
    rest, prime = n, 2
    while rest > 1:
        if rest % prime:
            prime = prime + 1 if prime * prime <= rest else rest
            continue
        period = n // prime
        if np.array_equal(part[period:], part[:-period]):
            return False
        while rest % prime == 0:
            rest //= prime
    return True


def _crossing(words: np.ndarray, squares: Squares, start: np.ndarray, middle: np.ndarray, end: np.ndarray, times: int, least: int) -> list[tuple]:
    """``(join, start, end, period)`` of the stretches in each join that cross its middle and are long enough for a run.

    Such a stretch has four periods or more (``times``), so two of them lie right before or right after the middle.
    """
    half = times // 2
    most = np.minimum(np.maximum(middle - start, end - middle) // half, (end - start) // times)
    found = []
    todo = np.flatnonzero(most > 0)
    edges = np.searchsorted(np.cumsum(most[todo]), np.arange(0, most[todo].sum() + LOOKED_AT, LOOKED_AT), side="left")
    for low, high in zip(edges, [*edges[1:], len(todo)], strict=False):
        some = todo[low:high]
        if not len(some):
            continue
        join = np.repeat(some, most[some])
        period = np.arange(len(join)) - np.repeat(np.cumsum(most[some]) - most[some], most[some]) + 1
        reach: dict[tuple[int, bool], int] = {}
        for right in (True, False):
            side = end[join] - middle[join] if right else middle[join] - start[join]
            fits = np.flatnonzero(side >= 2 * period)
            place = middle[join[fits]] - (0 if right else 2 * period[fits])
            hit = fits[squares.at(place, period[fits])]
            for j, q in zip(join[hit].tolist(), period[hit].tolist(), strict=True):
                # Within a stretch of a shorter period only its multiples repeat: no new root.
                if reach.get((j, right), 0) >= 2 * q:
                    continue
                s, m, e = int(start[j]), int(middle[j]), int(end[j])
                at = m if right else m - q  # words before and behind this repeat q places on
                a = at - _agree(words[s:at][::-1], words[s + q : at + q][::-1])
                b = at + q + _agree(words[at : e - q], words[at + q : e])
                reach[j, right] = max(reach.get((j, right), 0), b - m if right else m - a)
                if b - a >= max(least, times * q) and a < m < b and _primitive(words[a : a + q]):
                    found.append((j, a, b, q))
    return found


def runs_of(words: np.ndarray, owner: np.ndarray, times: int = LEAST_TIMES, least: int = LEAST_WORDS) -> np.ndarray:
    """``(start, length, period)`` of every maximal run, by start and period, in the places of ``words``.

    A run is a stretch of words of one owner that are equal ``period`` places apart, where no smaller period
    does and no neighbouring word goes on; it has ``least`` words and ``times`` periods at least.
    """
    if times < LEAST_TIMES:
        raise ValueError("a run of fewer periods need not have a square beside a boundary that it crosses")
    rounds, rest = repair(words, owner)
    squares = Squares(words)
    spans = []
    for name, start, middle, end in rounds:
        _, first = np.unique(name, return_index=True)  # one place of each rule stands for all
        own = _crossing(words, squares, start[first], middle[first], end[first], times, least)
        if own:
            which, a, b, q = np.array(own).T
            by_rule = np.argsort(name, kind="stable")
            low, high = (np.searchsorted(name[by_rule], name[first[which]], side) for side in ("left", "right"))
            many = high - low
            place = by_rule[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            move = start[place] - np.repeat(start[first[which]], many)
            spans.append(np.column_stack([np.repeat(a, many) + move, np.repeat(b, many) + move, np.repeat(q, many)]))
    for start, middle, end in _joins(*rest):
        own = _crossing(words, squares, start, middle, end, times, least)
        if own:
            spans.append(np.array(own)[:, 1:])
    if not spans:
        return np.zeros((0, 3), np.int64)
    spans = np.concatenate(spans)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0], spans[:, 2]))]
    a, b, q = spans.T
    # Two stretches of a period that share a period's length are one; those of an owner end before the next.
    new = np.ones(len(a), bool)
    far = np.maximum.accumulate(b + (q * (2 * len(words) + 2))) - q * (2 * len(words) + 2)
    new[1:] = (q[1:] != q[:-1]) | (a[1:] + q[1:] > far[:-1])
    group = np.cumsum(new) - 1
    stop = np.zeros(group[-1] + 1, np.int64)
    np.maximum.at(stop, group, b)
    out = np.column_stack([a[new], stop - a[new], q[new]])
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _batches(texts: list, most: int):
    """Ranges of texts of about ``most`` words together."""
    first = held = 0
    for i, words in enumerate(texts):
        if held and held + len(words) > most:
            yield first, i
            first, held = i, 0
        held += len(words)
    yield first, len(texts)


def periodic_runs(
    docs: DataFrame, times: int = LEAST_TIMES, least: int = LEAST_WORDS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, n_words, runs, collapsed`` of every whole text; no row moves.

    Words are parted by blanks and control characters 9 to 13; ``runs`` holds (start, length, period) by start,
    then period, words numbered from 0. ``collapsed`` are the words without those that a run has behind its
    first period, joined by blanks. Null and empty texts have no words. Rows that repeat are rows each, null
    keys stay, further columns are ignored, an empty table gives no rows. A task holds the words of one
    Arrow batch and the grammar of WORDS_AT_ONCE words, or of one text where it is longer; time and memory
    grow with a text's length times its logarithm.
    """

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
            out: list[list] = [[], [], []]
            for low, high in _batches(texts, WORDS_AT_ONCE):
                sizes = np.array([len(t) for t in texts[low:high]], np.int64)
                ids = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(texts[low:high])))}
                words = np.fromiter(map(ids.__getitem__, chain.from_iterable(texts[low:high])), np.int64, sizes.sum())
                owner = np.repeat(np.arange(len(sizes)), sizes)
                found = runs_of(words + owner * len(ids), owner, times, least)
                starts = np.cumsum(sizes) - sizes
                edges = np.searchsorted(found[:, 0], [*starts, sizes.sum()])
                for n, (text_words, first) in enumerate(zip(texts[low:high], starts, strict=True)):
                    runs = found[edges[n] : edges[n + 1]] - [first, 0, 0]
                    if len(runs):
                        gone = np.zeros(len(text_words) + 1, np.int64)
                        np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
                        np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
                        text_words = [w for w, g in zip(text_words, np.cumsum(gone).tolist(), strict=False) if not g]
                    out[0].append(int(sizes[n]))
                    out[1].append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()])
                    out[2].append(b" ".join(text_words))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            columns = [pa.array(out[0], pa.int64()), pa.array(out[1], kind), pa.array(out[2], pa.binary()).cast(pa.string())]
            yield pa.record_batch([batch.column(0), *columns], names=[key, "n_words", "runs", "collapsed"])

    of_key = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {of_key}, n_words long, runs array<struct<start long, length long, period long>>, collapsed string"
    return docs.select(key, text).mapInArrow(run, schema)


def repeated_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text``, where the words of about a tenth of the texts repeat from some word on.

    With h = crc32 of the key as text and g = h // 10, the words of a text with h % 10 = 0 are, from word a = g % n
    on, its words a to a + p - 1 again and again, p = 1 + (n - a) // (3 + g % 8), joined by blanks. Other texts, those
    without words and those with a null key stay as they are.
    """
    h = F.crc32(F.col(key).cast("string"))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    parted = docs.select(key, text, F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    parted = parted.withColumn("n", F.size("words"))
    parted = parted.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    parted = parted.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    tail = "slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)"
    again = F.expr(f"array_join(concat(slice(words, 1, a), {tail}), ' ')")
    return parted.select(key, F.when(F.col("a").isNotNull(), again).otherwise(F.col(text)).alias(text))


def run_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of ``periodic_runs``: number of runs, the longest one, and digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat_ws("", F.transform(lines, lambda line: F.concat(line, F.lit("\n"))))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"], r["period"])))
    counted = found.select(key, "runs", "collapsed", best.alias("best"))
    length = -F.col("best.less")
    return counted.select(
        key, F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"),
        F.col("best.period").alias("period"), F.expr("-1000 * best.less div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
