"""Operator 3: near-duplicate components by MinHash with sequential Bayesian verification.

1. Each text's shingle set gets a signature of ``BANDS * ROWS`` minima and one key a band.
   Texts with equal sets are linked at once and only the smallest doc_id's goes on.
2. Each band key links its documents with the smallest of them (a star, not all pairs): at
   first only the star a document shares most keys with, then those of other components.
   Candidate pairs are compared a batch of minima at a time; a pair is dropped as soon as
   the posterior chance of reaching the threshold, given the matches so far and a uniform
   prior, is below ``MISS``. Survivors are confirmed on their full sets.
3. Documents of one key that still lie in different components are compared pair by pair
   in the same way, in blocks of bounded size, and those left are held against 32-bit folds
   of their sets there, which lets no similar pair go: no link between different components is
   left out. Pairs in one component need no test: it could not change the result.

With 32 bands of 5 rows, a pair at similarity 0.8 shares no key with chance 3e-6.

Nulls: a null text, or one without words, has an empty set and is alone; a null doc_id is
alone in a component null and kept. Rows with the same doc_id are one node with the links
of all its texts. A very long text is sketched whole, in memory of its own size. Ties for
the closest star go to the smallest doc_id. An empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import marked, packed, staged, table, text_batches, unpacked
from .components import components
from .shingles import U, mix, shingle_sets

BANDS, ROWS = 32, 5
MINIMA = BANDS * ROWS
BATCH = 32
MISS = 1e-7
BLOCK = 512
FOLDS = 1 << 20
#: fixed pseudo-random 32-bit multipliers and offsets, one pair for each minimum
SEEDS = mix(np.arange(1, 2 * MINIMA + 1, dtype=U)).astype(np.uint32).reshape(2, MINIMA, 1)
SKETCH = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, signature binary"


def signature(values: np.ndarray) -> np.ndarray:
    """Minima of the set under each of the hash functions."""
    low = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    x = (values ^ values >> U(32)).astype(np.uint32)
    for a in range(0, len(x), 2048):
        v = (x[a : a + 2048] ^ SEEDS[0]) * (SEEDS[1] | np.uint32(1))
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        v ^= v >> np.uint32(13)
        np.minimum(low, v.min(axis=1), out=low)
    return low


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One key for each row and band; the band's number is part of it."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(U)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), parts.shape[:2])
    for i in range(ROWS):
        h = mix((h ^ parts[:, :, i]) * U(0x9FB21C651E98DF25))
    return h.view(np.int64)


def least_matches(percent: int) -> dict[int, int]:
    """Minima compared -> fewest matches with which a pair goes on. Under a uniform prior
    P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m)."""
    t, out = percent / 100, {}
    for n in range(BATCH, MINIMA + 1, BATCH):
        chance, m = 0.0, -1
        while chance < MISS:
            m += 1
            chance += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def sketches(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in text_batches(batches):
            sets = shingle_sets(batch.column(1), k)
            sigs = np.array([signature(s) for s in sets], np.uint32).reshape(len(sets), MINIMA)
            digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), "<i8").reshape(-1, 2)
            keys = band_keys(sigs)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests[:, 0]),
                    pa.array(digests[:, 1]),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1))),
                    pa.array([s.tobytes() for s in sigs], pa.binary()),
                ],
                ["doc_id", "n_shingles", "s1", "s2", "bands", "signature"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SKETCH)


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is one of ``ids`` (staged). Only rows that may be are moved by the
    join, as texts and signatures are wide."""
    return marked(rows, ids, "doc_id").filter("maybe").drop("maybe").join(ids, "doc_id", "left_semi")


def without_copies(rows: DataFrame, equal: DataFrame) -> DataFrame:
    """The rows whose (doc_id, s1, s2) is none of ``equal`` (staged). Rows that may be are joined
    and written, once for all uses; the others stay where they are read."""
    held = marked(rows, equal, "doc_id")
    tested = staged(held.filter("maybe").drop("maybe").join(equal, ["doc_id", "s1", "s2"], "left_anti").select(*rows.columns), "tested")
    return held.filter("NOT maybe").drop("maybe").unionByName(tested)


def firsts(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys and ``first``, the smallest doc_id, of keys that several documents share.
    Written, so that joining it with a key of very many rows may be split."""
    return staged(rows.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select(*keys, "first"), name)


def plausible(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs that sequential comparison of signatures leaves."""
    least = least_matches(percent)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, MINIMA) for i in (2, 3))
            alive, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
            for n, m in least.items():
                matches = matches + (x[alive, n - BATCH : n] == y[alive, n - BATCH : n]).sum(axis=1)
                go = matches >= m
                alive, matches = alive[go], matches[go]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(alive)) for c in batch.columns[:2]], ["a", "b"])

    for c in ("a", "b"):
        pairs = pairs.join(signatures.select(F.col("doc_id").alias(c), F.col("signature").alias(f"s{c}")), c)
    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough: 100 * common >= percent * union."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    for c in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"s{c}")), c)
    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """doc_id, shingles (64-bit hashes), short (their distinct 32-bit folds) and n."""

    def run(batches):
        for batch in text_batches(batches):
            sets = shingle_sets(batch.column(1), k)
            short = [np.unique((s ^ s >> U(32)).astype("<u4")).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(short, pa.binary()), pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "shingles", "short", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return among(rows, ids).mapInArrow(run, "doc_id long, shingles binary, short binary, n long")


def common_at_most(x: np.ndarray, lost: int, others: list[np.ndarray], lost_others: np.ndarray) -> np.ndarray:
    """No fewer than the shingles that a set shares with each other one, from their sorted
    folds and how many shingles each lost by folding."""
    out, a = np.zeros(len(others), np.int64), 0
    edges = np.cumsum([0, *map(len, others)])
    while a < len(others):  # a few megabytes at a time
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + FOLDS, side="right")) - 1)
        flat = np.concatenate(others[a:b])
        hit = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
        out[a:b] = np.add.reduceat(hit, edges[a:b] - edges[a])
        a = b
    return out + np.minimum(lost, lost_others)


def in_components(rows: DataFrame, part: DataFrame) -> DataFrame:
    """doc_id, component and bands of each row; alone where no link is known."""
    named = rows.select("doc_id", "bands").join(part.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return named.select("doc_id", F.coalesce("component", "doc_id").alias("component"), "bands")


def star_members(rows: DataFrame, name: str) -> DataFrame:
    """doc_id and ``first``, the smallest doc_id of a shared key, for each key of a document
    whose first document lies in another component. Only keys that span components are
    written and joined, so that a key of very many rows may be split."""
    keyed = rows.select("doc_id", "component", F.explode("bands").alias("key"))
    spanning = keyed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min(F.struct("doc_id", "component")).alias("f")).filter("x < y")
    firsts = staged(spanning.select("key", F.col("f.doc_id").alias("first"), F.col("f.component").alias("own")), name + "-keys")
    return keyed.join(firsts, "key").filter("component <> own").select("doc_id", "first")


def across(documents: DataFrame, signatures: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs between different components within each key of the documents (doc_id,
    component, bands) that signatures leave and whose folded sets may be similar enough.
    Keys of many documents are dealt into pairs of blocks."""
    least = least_matches(percent)
    members = documents.select("doc_id", "component", F.explode("bands").alias("key"))
    sizes = staged(members.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "mixed-keys")
    rows = members.join(sizes, "key").join(signatures.select("doc_id", "signature"), "doc_id").join(sets.select("doc_id", "short", "n"), "doc_id")
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    rows = rows.select("key", "doc_id", "component", "signature", "short", "n", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def run(group: pa.Table) -> pa.Table:
        ids, parts, blocks = (group.column(c).to_numpy() for c in ("doc_id", "component", "block"))
        key, low, high = (group.column(c)[0].as_py() for c in ("key", "low", "high"))
        sig = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint32).reshape(-1, MINIMA)
        short = [np.frombuffer(x, "<u4") for x in group.column("short").to_pylist()]
        n = group.column("n").to_numpy()
        lost = n - np.array([len(x) for x in short])
        keys = band_keys(sig)
        band = int(np.flatnonzero((keys == key).any(axis=0))[0])
        left, right = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
        a, b = [], []
        for i in left:
            j = right[(parts[right] != parts[i]) & ((ids[right] > ids[i]) | (low != high))]
            j = j[~(keys[j, :band] == keys[i, :band]).any(axis=1)]  # pairs of an earlier key are tested there
            matches = np.zeros(len(j), np.int64)
            for upto, m in least.items():
                matches = matches + (sig[j, upto - BATCH : upto] == sig[i, upto - BATCH : upto]).sum(axis=1)
                go = matches >= m
                j, matches = j[go], matches[go]
            common = common_at_most(short[i], lost[i], [short[x] for x in j], lost[j])
            j = j[100 * common >= percent * (n[i] + n[j] - common)]
            a.append(np.minimum(ids[i], ids[j]))
            b.append(np.maximum(ids[i], ids[j]))
        return pa.table({"a": np.concatenate(b) if b else np.zeros(0, np.int64), "b": np.concatenate(a) if a else np.zeros(0, np.int64)})

    return rows.groupBy("key", "low", "high").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``."""
    sketch = staged(sketches(docs, k), "sketches")
    linked = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # equal sets
    shared = firsts(linked.select("doc_id", "s1", "s2"), ["s1", "s2"], "equal-sets")
    equal = staged(linked.select("doc_id", "s1", "s2").join(shared, ["s1", "s2"]).filter("doc_id > first").distinct(), "equal")
    one = without_copies(linked, equal)
    # a document of copies of one other alone follows it; one with further texts is a node linked with each
    more_texts = one.select("doc_id").join(equal, "doc_id", "left_semi")
    reps = equal.groupBy("doc_id").agg(F.min("first").alias("rep"), F.max("first").alias("last")).filter("rep = last")
    follows = staged(reps.select("doc_id", "rep").join(more_texts, "doc_id", "left_anti"), "follows")
    copied = staged(equal.join(follows, "doc_id", "left_anti").select(F.col("doc_id").alias("a"), F.col("first").alias("b")), "copied")
    # stars of the band keys: first each document's closest one, then those that still join components
    members = staged(star_members(one.select("doc_id", F.col("doc_id").alias("component"), "bands"), "members"), "members")
    ids = staged(members.select("doc_id").unionByName(members.select(F.col("first").alias("doc_id"))).distinct(), "ids")
    signatures = staged(among(one.select("doc_id", "signature", "bands"), ids), "signatures")
    sets = staged(full_sets(docs, ids, k), "sets")
    closest = members.groupBy("doc_id", "first").agg(F.count("*").alias("n")).groupBy(F.col("doc_id").alias("a")).agg(F.max_by("first", F.struct("n", -F.col("first"))).alias("b"))
    links = copied.unionByName(staged(confirmed(plausible(closest, signatures, percent), sets, percent), "links"))
    again = star_members(in_components(signatures, components(links)), "members-again").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()
    links = links.unionByName(staged(confirmed(plausible(again, signatures, percent), sets, percent), "links-again"))
    part = components(links)
    # documents of a key in different components
    more = staged(confirmed(across(in_components(signatures, part), signatures, sets, percent), sets, percent), "more-links")
    if more.limit(1).count():
        part = components(links.unionByName(more))
    # copies follow the document that stands for them
    nodes = sketch.select("doc_id", "n_shingles").join(follows, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    ends = nodes.join(part.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return ends.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is kept; its own columns. Further rows with
    the doc_id of a kept document stay with it."""
    gone = near_duplicates(docs, k, percent).filter("NOT kept").select("doc_id").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), packed(docs.columns).alias("own"))
    return unpacked(rows.join(gone, "doc_id", "left_anti"), "own", docs.columns)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


OP3_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
      JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS root FROM w UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node WHERE reach.root < links.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) c ON c.node = w.doc_id"""
