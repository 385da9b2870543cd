"""Operator 13: runs of periodic words by the linear tandem-repeat method.

Words are numbered from 0 in each text. A run of period q and at least three periods has every
window of ``SHORT`` words twice within it, so first the stretches of words whose windows repeat
in the same text are found; whatever lies outside them is in no run. The stretches of a batch
of texts, each with symbols of its own, then form one string, and on it:

1. a suffix array with ranks of all power-of-two lengths (which answer how far two places agree
   forwards and backwards) gives the Lempel-Ziv blocks;
2. at each block border, squares whose centre lies in a block or that begin in it and end in the
   next are found by the two extensions around it. They cover the leftmost place of every
   square; squares of a word that is itself a power are left out;
3. in the suffix tree, made of the same array, each is rotated along suffix links until a
   square already seen or none comes: the places reached are the complete vocabulary;
4. the leaves below each place are the occurrences of its square, and occurrences of one period
   at neighbouring places merge into runs.

Steps 1, 2 and 4 work on whole arrays; the walks of steps 1 and 3 are plain loops whose length is
linear in the words of the stretches.

Nulls: a null text has no words and no runs; a null doc_id is carried. Repeated rows are each
judged. A very long text is a batch of its own in its task. Ties between runs: see
``strongest``. Empty texts have an empty list of runs and collapse to empty text; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_batches

#: A run has at least this many words and periods.
SHORTEST, PERIODS = 24, 3
#: Longest window that any run repeats over all of itself: 2 * q + SHORT - 1 words are enough,
#: and max(24, 3 * q) is never less for 8.
SHORT = 8
U = np.uint64
RUNS = "array<struct<start:long,length:long,period:long>>"


def ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, value) of all integers of the ranges start, start + 1, ..."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


class Text:
    """A string of integers with ranks of its substrings of 1, 2, 4, ... symbols."""

    def __init__(self, symbols: np.ndarray):
        self.n = n = len(symbols)
        rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        self.symbols, self.ranks = rank, [rank]
        step = 1
        while n and rank.max() < n - 1:
            after = np.zeros(n, np.int64)
            after[: max(0, n - step)] = rank[step:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank, step = new, 2 * step
            self.ranks.append(rank)
        self.rank = rank
        self.suffixes = np.argsort(rank, kind="stable")
        # equal ranks stand for equal substrings only where both lie within the text
        self.ranks = [r.astype(np.int32) for r in self.ranks]

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of the suffixes at a and b (a, b differ)."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            r, step = self.ranks[k], 1 << k
            ok = (np.maximum(a, b) + step <= self.n) & (a < self.n) & (b < self.n)
            ok[ok] = r[a[ok]] == r[b[ok]]
            out[ok] += step
            a[ok] += step
            b[ok] += step
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common end of the prefixes up to a and b, both included."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            r, step = self.ranks[k], 1 << k
            ok = np.minimum(a, b) - step + 1 >= 0
            ok[ok] = r[a[ok] - step + 1] == r[b[ok] - step + 1]
            out[ok] += step
            a[ok] -= step
            b[ok] -= step
        return out

    def common(self) -> np.ndarray:
        """Common beginning of neighbours in suffix order; 0 for the first one."""
        lcp = np.zeros(self.n, np.int64)
        if self.n > 1:
            lcp[1:] = self.forward(self.suffixes[:-1], self.suffixes[1:])
        return lcp

    def blocks(self) -> np.ndarray:
        """Starts of the Lempel-Ziv blocks and the end: a block is the longest beginning of
        what is left that also starts earlier, or a new symbol."""
        suffix, n = self.suffixes.tolist(), self.n
        lower, upper, stack = [-1] * n, [-1] * n, []
        for i in suffix:  # nearest suffixes on either side that start earlier
            while stack and stack[-1] > i:
                upper[stack.pop()] = i
            lower[i] = stack[-1] if stack else -1
            stack.append(i)
        place = np.arange(n)
        longest = np.zeros(n, np.int64)
        for near in (np.array(lower, np.int64), np.array(upper, np.int64)):
            has = near >= 0
            longest[has] = np.maximum(longest[has], self.forward(place[has], near[has]))
        longest, at, starts = longest.tolist(), 0, []
        while at < n:
            starts.append(at)
            at += longest[at] or 1
        return np.array([*starts, n], np.int64)


def covering_squares(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares of primitive words that cover, by steps to the right over
    further squares, the leftmost place of every such square."""
    edge = text.blocks()
    size = np.diff(edge)
    starts, periods = [], []
    # centre within the block: compare its end with places before it
    b, k = ranges(np.ones(len(size), np.int64), size)
    h = edge[b + 1]
    found = _squares_at(text, h, h - k, k)
    starts.append(found[0])
    periods.append(found[1])
    # from this block into the next one: compare its start with places after it
    b, k = ranges(np.ones(len(size), np.int64), size + np.append(size[1:], 0))
    h, end = edge[b], edge[b + 1]
    found = _squares_at(text, h, h + k, k, end)
    starts.append(found[0])
    periods.append(found[1])
    start, period = np.concatenate(starts), np.concatenate(periods)
    primitive = _primitive(text, start, period)
    return start[primitive], period[primitive]


def _squares_at(text: Text, h: np.ndarray, q: np.ndarray, k: np.ndarray, end: np.ndarray | None = None):
    """Squares of period k from the extensions of h and q, k apart. With ``end`` (of the block
    that begins at h) only those that begin before h and have their centre before ``end``."""
    ok = (np.maximum(h, q) < text.n) & (h != q)
    ok[ok] = text.symbols[h[ok]] == text.symbols[q[ok]]
    if end is not None:
        ok &= h > 0
        ok[ok] = text.symbols[h[ok] - 1] == text.symbols[q[ok] - 1]
        end = end[ok]
    h, q, k = h[ok], q[ok], k[ok]
    ahead, back = text.forward(h, q), text.backward(h - 1, q - 1)
    low = np.minimum(h, q)
    start = np.maximum(low - back, low - k + 1)
    ok = ahead + back >= k
    if end is not None:
        ok &= start + k <= end
    return start[ok], k[ok]


def _primitive(text: Text, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the first ``period`` symbols from ``start`` are no power of a shorter word."""
    ok = np.ones(len(start), bool)
    if not len(start):
        return ok
    factor = np.arange(int(period.max()) + 1)
    for p in range(2, int(len(factor) ** 0.5) + 1):
        if factor[p] == p:
            own = factor[p * p :: p]
            own[own == np.arange(p * p, len(factor), p)] = p
    rest = period.copy()
    while (rest > 1).any():
        p = factor[rest]
        test = np.flatnonzero(rest > 1)
        shift = period[test] // p[test]
        same = text.forward(start[test], start[test] + shift)
        ok[test[same >= period[test] - shift]] = False
        rest[test] //= p[test]
    return ok


class SuffixTree:
    """Suffix tree from the suffix array: inner nodes are intervals of it, leaf i is ~i."""

    def __init__(self, text: Text):
        self.text, n = text, text.n
        self.symbol = text.symbols.tolist()
        suffix, lcp = text.suffixes.tolist(), text.common()
        self.suffix = suffix
        rows = lcp.tolist()
        depth, low, high, parent = [0], [0], [n], [-1]
        leaf_parent, node_of = [0] * n, [0] * n
        stack = [0]
        for r in range(1, n + 1):
            d, last, left = rows[r] if r < n else 0, -1, r - 1
            leaf = r - 1
            held = False
            while depth[stack[-1]] > d:
                v = stack.pop()
                if not held:
                    leaf_parent[suffix[leaf]], held = v, True
                high[v], left = r, low[v]
                if last >= 0:
                    parent[last] = v
                last = v
            top = stack[-1]
            if depth[top] < d:
                depth.append(d)
                low.append(left)
                high.append(n)
                parent.append(-1)
                top = len(depth) - 1
                stack.append(top)
            if not held:
                leaf_parent[suffix[leaf]] = top
            if last >= 0:
                parent[last] = top
            if r < n:
                node_of[r] = top
        self.depth, self.low, self.high, self.parent, self.leaf_parent = depth, low, high, parent, leaf_parent
        child = {}
        width = int(text.symbols.max(initial=0)) + 1
        self.width = width
        for v in range(1, len(depth)):
            child[parent[v] * width + self.symbol[suffix[low[v]] + depth[parent[v]]]] = v
        for i, v in enumerate(leaf_parent):
            if i + depth[v] < n:
                child[v * width + self.symbol[i + depth[v]]] = ~i
        self.child = child
        self.link = self._links(lcp, np.array(node_of, np.int64))

    def _links(self, lcp: np.ndarray, node_of: np.ndarray) -> list[int]:
        """Suffix link of each inner node: the node of its first and last leaf, one further on."""
        n, rank, suffix = self.text.n, self.text.rank, self.text.suffixes
        low, high, depth = np.array(self.low), np.array(self.high) - 1, np.array(self.depth)
        link = np.zeros(len(low), np.int64)
        v = np.flatnonzero(depth > 1)
        if len(v):
            a, b = rank[suffix[low[v]] + 1], rank[suffix[high[v]] + 1]
            a, b = np.minimum(a, b) + 1, np.maximum(a, b)
            best = lcp * (n + 1) + np.arange(n)  # smallest value, then leftmost
            table_, levels = [best], int(max(1, (b - a + 1).max())).bit_length()
            for k in range(1, levels):
                t = table_[-1]
                table_.append(np.minimum(t[: n - (1 << k) + 1], t[1 << (k - 1) :][: n - (1 << k) + 1]))
            level = np.frompyfunc(int.bit_length, 1, 1)((b - a + 1).astype(object)).astype(np.int64) - 1
            least = np.empty(len(v), np.int64)
            for k in range(levels):
                of = level == k
                least[of] = np.minimum(table_[k][a[of]], table_[k][b[of] - (1 << k) + 1])
            link[v] = node_of[least % (n + 1)]
        return link.tolist()

    def top_of(self, v: int) -> tuple[int, int]:
        """Depth of a node's parent and of itself."""
        if v < 0:
            return self.depth[self.leaf_parent[~v]], self.text.n - ~v
        return (self.depth[self.parent[v]] if v else -1), self.depth[v]

    def first(self, v: int) -> int:
        return ~v if v < 0 else self.suffix[self.low[v]]

    def above(self, v: int) -> int:
        return self.leaf_parent[~v] if v < 0 else self.parent[v]


def vocabulary(text: Text, start: np.ndarray, period: np.ndarray) -> list[tuple[int, int, int]]:
    """(first leaf, end of leaves, period) in suffix order of each distinct square reached from
    the given ones by rotation: where a word a w a w stands, w a w is found by the suffix link,
    and w a w a stands in the text if the tree goes on with a."""
    if not len(start):
        return []
    tree, seen, out = SuffixTree(text), set(), []
    depth, child, width, symbol, link, low, high = tree.depth, tree.child, tree.width, tree.symbol, tree.link, tree.low, tree.high
    deep = np.array(depth)
    up = [np.maximum(0, np.array(tree.parent))]  # ancestors 1, 2, 4, ... up
    while up[-1].any():
        up.append(up[-1][up[-1]])
    node = np.array(tree.leaf_parent)[start]
    inner = deep[node] >= 2 * period
    for jump in reversed(up):
        higher = jump[node]
        go = inner & (deep[higher] >= 2 * period)
        node = np.where(go, higher, node)
    places = np.where(inner, node, ~start)
    for i, k, v in zip(start.tolist(), period.tolist(), places.tolist(), strict=True):
        m = 2 * k
        while (v, m) not in seen:
            seen.add((v, m))
            if v < 0:
                r = int(text.rank[~v])
                out.append((r, r + 1, k))
            else:
                out.append((low[v], high[v], k))
            a = symbol[i]
            # the suffix link of the place: from the node above, then down by whole edges
            u = tree.above(v)
            w = link[u] if u > 0 else 0
            i += 1
            at = depth[w]
            while True:
                if at == m - 1 and w >= 0:
                    nxt = child.get(w * width + a)
                    break
                c = child[w * width + symbol[i + at]]
                low_end = depth[c] if c >= 0 else text.n - ~c
                if low_end > m - 1:  # within an edge: one way on
                    f = tree.first(c) + m - 1
                    nxt = c if f < text.n and symbol[f] == a else None
                    break
                if low_end == m - 1 and c < 0:
                    nxt = None
                    break
                w, at = c, low_end
            if nxt is None:
                break
            v = nxt
            i = tree.first(v)
    return out


def periodic_runs(symbols: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs of at least two periods, by start, then period."""
    text = Text(symbols)
    squares = np.array(vocabulary(text, *covering_squares(text)), np.int64).reshape(-1, 3)
    which, leaf = ranges(squares[:, 0], squares[:, 1] - squares[:, 0])
    start, period = text.suffixes[leaf], squares[which, 2]
    order = np.lexsort((start, period))
    start, period = start[order], period[order]
    fresh = np.flatnonzero(np.concatenate([[True], (np.diff(start) != 1) | (np.diff(period) != 0)])) if len(start) else np.zeros(0, np.int64)
    last = np.append(fresh[1:], len(start)) - 1
    runs = np.stack([start[fresh], start[last] + 2 * period[fresh] - start[fresh], period[fresh]], axis=1) if len(start) else np.zeros((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts, and where each text's begin."""
    parts = pa.compute.ascii_split_whitespace(column.cast(pa.large_string()).fill_null(""))
    edges, words = parts.offsets.to_numpy(), parts.flatten()
    real = pa.compute.not_equal(words, "").to_numpy(zero_copy_only=False)
    return words.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])[edges - edges[0]]


def stretches(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words covered by windows that come twice in their
    text, of at least the shortest run's length."""
    m = len(codes) - SHORT + 1
    none = np.zeros(0, np.int64)
    if m < 2:
        return none, none
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    h = text[:m].astype(U)
    for i in range(SHORT):
        h = (h ^ codes[i : i + m].astype(U)) * U(0x9FB21C651E98DF25)
        h ^= h >> U(29)
    inside = text[:m] == text[SHORT - 1 :]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice & inside)
    if not len(at):
        return none, none
    # windows that overlap or touch, in one text, make one stretch
    fresh = np.concatenate([[True], (np.diff(at) > SHORT) | (np.diff(text[at]) != 0)])
    starts = at[fresh]
    ends = at[np.append(np.flatnonzero(fresh)[1:], len(at)) - 1] + SHORT
    long = ends - starts >= SHORTEST
    return starts[long], ends[long]


def runs_of(column: pa.Array) -> tuple[list[list[tuple[int, int, int]]], pa.Array, np.ndarray, np.ndarray]:
    """Runs of each text; the words of all texts, where each text's begin, and which are kept."""
    words, first = words_of(column)
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    starts, ends = stretches(codes, first)
    kept = np.ones(len(codes), bool)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(first) - 1)]
    if len(starts):
        which, place = ranges(starts, ends - starts)
        runs = periodic_runs(which * (int(codes.max()) + 1) + codes[place])
        long = runs[:, 1] >= np.maximum(SHORTEST, PERIODS * runs[:, 2])
        runs = runs[long]
        text = np.searchsorted(first, place[runs[:, 0]], side="right") - 1
        for t, at, (_, length, period) in zip(text.tolist(), place[runs[:, 0]].tolist(), runs.tolist(), strict=True):
            found[t].append((at - int(first[t]), length, period))
            kept[at + period : at + length] = False
    return found, words, first, kept


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (array of start, length and period by start, then period) and ``collapsed``
    (the words that no run repeats, joined by one space) of each row."""

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in text_batches(batches):
            found, words, first, kept = runs_of(batch.column(1))
            left = np.concatenate([[0], np.cumsum(kept)])[first]
            lists = pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words.filter(pa.array(kept)))
            collapsed = pa.compute.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())
            runs = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in x] for x in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), runs, collapsed], ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period, the first (then shortest period) of ties."""
    better = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a))


def planted(docs: DataFrame) -> DataFrame:
    """Texts of which a tenth, by crc32 of doc_id, repeat p words from word a on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    space = r"[\x20\x09-\x0D]+"
    core = F.btrim("text", F.lit(" \t\n\x0b\f\r"))
    words = F.when((h % 10 == 0) & (F.length(core) > 0), F.split(core, space))
    rows = docs.select("doc_id", "text", words.alias("words"), F.floor(h / 10).cast("long").alias("g"))
    n = F.size("words").cast("long")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", F.when(n > 0, 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)).cast("long")))
    a, p = F.col("a"), F.col("p")
    turned = F.transform("words", lambda w, i: F.when(i >= a, F.get("words", (a + (i - a) % p).cast("int"))).otherwise(w))
    return rows.select("doc_id", F.coalesce(F.array_join(turned, " "), F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_runs(planted(table(spark, sf_dir, "documents"))).withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
