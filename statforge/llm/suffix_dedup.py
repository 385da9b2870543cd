"""Operator 1: removal of byte strings that also start in an earlier document.

Hash matching on a difference cover, in place of suffix sorting: names are hashes and keep
no order, nothing recurses, and no order of suffixes is built or merged. The question asks
only which ``SPAN``-byte windows are equal, not how suffixes compare, so equality of names
is enough; a window's own hash decides, hence order could not change the result. The cover
holds 5 of every 21 positions such that any two positions i, j have a shift d < 21 with
i + d and j + d both in it; equal windows at i and j thus hold an aligned pair of sampled
positions, each starting the same 30 bytes.

1. Sampled tuples: the 30 bytes at each sampled position get a name (a hash) and names
   are matched; only names found in two documents or more go on.
2. Contexts: each surviving sample is named by the 70 bytes that hold every
   window it may decide. If all occurrences of a name share that context, the smallest
   document decides for all of its windows at once.
3. Windows: those of samples whose contexts differ are named by their own
   50 bytes and matched; equal names give the smallest document.

Documents are dealt into homes by a hash and each step asks, for sorted lists of names, in
which documents else they occur: a home sends one packed list for each range of names and
gets one bit for each name back. Names are distinct within a home's list, so a string on
a third of all documents is one entry a home, not one a document. Names of step 1 only
filter; what removes bytes compares at least 64 bits of hash.

Nulls: a null text is empty; a document with null doc_id counts as later than all others.
Rows with equal doc_id are one document, and do not remove from each other. Texts under 50
bytes are never touched. A very long text lies in one home, whose task holds it whole. Ties
do not arise, as only the smallest doc_id matters. An empty table gives no rows; other
columns are carried along and may have any names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, table, utf8_column

SPAN = 50
PERIOD = 21
COVER = (3, 6, 7, 12, 14)
NAME = SPAN - PERIOD + 1
NAME_BITS = 28
PAD = 64
NEVER = np.iinfo(np.int64).max
ASK = "kind int, bucket int, home int, n int, body binary"
ANSWER = "home int, kind int, bucket int, n int, body binary"
ASK_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("home", pa.int32()), ("n", pa.int32()), ("body", pa.binary())])
ANSWER_SCHEMA = pa.schema([("home", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("body", pa.binary())])
U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def pack(*columns: np.ndarray) -> bytes:
    """Byte planes of unsigned columns, compressed; equal high bytes cost next to nothing."""
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
    size = len(planes).to_bytes(8, "little")
    return size + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(body: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    planes = pa.decompress(body[8:], decompressed_size=int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    for kind in kinds:
        width = np.dtype(kind).itemsize
        part = np.frombuffer(planes, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(part.T).view(kind).reshape(n))
        at += n * width
    return out


def steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def spread(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(values, np.diff(np.append(starts, n)))


class Home:
    """The documents of a home and the names asked for in each step."""

    def __init__(self, rows: pa.Table, buckets: int):
        ids = rows.column("doc_id").combine_chunks()
        key = ids.fill_null(NEVER).to_numpy(zero_copy_only=False)
        order = np.argsort(key, kind="stable")
        self.rows = rows.take(pa.array(order))
        self.ids = key[order]
        self.buckets = buckets
        flat, offsets = utf8_column(self.rows.column("text"))
        self.n = len(flat)
        self.buf = np.zeros(self.n + 2 * PAD + 16, np.uint8)
        self.buf[PAD : PAD + self.n] = flat
        self.words = np.ndarray(len(self.buf) - 8, "<u8", self.buf.data, strides=(1,))
        self.edges = offsets + PAD
        self.doc_of = np.repeat(np.arange(len(key), dtype=np.int32), np.diff(offsets))
        #: rows with equal doc_id share the first one's number
        self.same = np.searchsorted(self.ids, self.ids, side="left").astype(np.int32)

    def doc(self, p: np.ndarray) -> np.ndarray:
        return self.doc_of[p - PAD]

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return (h >> U(32)) * U(self.buckets) >> U(32)

    def lists(self, kind: int, home: int, bucket: np.ndarray, *columns: np.ndarray) -> pa.Table:
        """One packed list for each bucket; rows come sorted by bucket, then first column,
        of which the differences are sent."""
        starts = run_starts(bucket) if len(bucket) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(bucket))
        bodies = [pack(steps(columns[0][a:b]), *(c[a:b] for c in columns[1:])) for a, b in zip(starts, ends, strict=True)]
        k = len(starts)
        return pa.table([np.full(k, kind, np.int32), bucket[starts].astype(np.int32), np.full(k, home, np.int32), (ends - starts).astype(np.int32), pa.array(bodies, pa.binary())], schema=ASK_SCHEMA)

    # step 1
    def sample(self) -> None:
        parts = []
        for c in COVER:
            p = np.arange(PAD + c, PAD + self.n, PERIOD)
            parts.append(p[p + NAME <= self.edges[self.doc(p) + 1]])
        p = np.concatenate(parts)
        h = np.full(len(p), U(0x9E3779B97F4A7C15))
        for k in (0, 8, 16, NAME - 8):
            h = mix(h ^ self.words[p + k])
        name = self.bucket(h) << U(NAME_BITS) | h & U((1 << NAME_BITS) - 1)
        order = np.argsort(name, kind="stable")
        self.p, self.name = p[order], name[order]
        self.starts = run_starts(self.name) if len(p) else np.zeros(0, np.int64)

    def ask_names(self, home: int) -> pa.Table:
        self.sample()
        if not len(self.p):
            return ASK_SCHEMA.empty_table()
        docs = self.same[self.doc(self.p)]
        several = np.minimum.reduceat(docs, self.starts) < np.maximum.reduceat(docs, self.starts)
        names = self.name[self.starts]
        return self.lists(1, home, names >> U(NAME_BITS), (names & U((1 << NAME_BITS) - 1)).astype("<u4"), several.view(np.uint8))

    # step 2
    def contexts(self, answers: dict[int, list[np.ndarray]]) -> None:
        if len(self.p):
            found = spread(answers[1][0], self.starts, len(self.p))
            self.p, self.name = self.p[found], self.name[found]
        p, d = self.p, self.doc(self.p)
        lo, hi = np.maximum(p - (PERIOD - 1), self.edges[d]), np.minimum(p, self.edges[d + 1] - SPAN)
        fit = hi >= lo
        p, d, lo, hi, name = p[fit], d[fit], lo[fit], hi[fit], self.name[fit]
        h = (p - lo).astype(U) * U(0xD6E8FEB86659FD93) + (p - hi).astype(np.int64).view(U) * U(0x9E3779B97F4A7C15)
        for k in range(0, SPAN + PERIOD - 1, 8):
            h = mix(h ^ self.words[np.clip(p - (PERIOD - 1) + k, lo, hi + SPAN - 8)])
        h &= U((1 << 48) - 1)
        order = np.lexsort((d, h, name))
        self.lo, self.hi, self.d, self.name, self.context = lo[order], hi[order], d[order], name[order], h[order]
        self.starts2 = run_starts(self.name, self.context) if len(p) else np.zeros(0, np.int64)

    def ask_contexts(self, home: int, answers) -> pa.Table:
        self.sample()
        self.contexts(answers)
        s = self.starts2
        if not len(s):
            return ASK_SCHEMA.empty_table()
        names, context = self.name[s], self.context[s]
        return self.lists(2, home, names >> U(NAME_BITS), (names & U((1 << NAME_BITS) - 1)).astype("<u4"), context.astype("<u4"), (context >> U(32)).astype("<u2"), self.ids[self.d[s]].astype("<i8"))

    def covered(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Mask over byte positions, padding included, of the union of [lo, hi]."""
        size = len(self.buf) + 1
        return np.cumsum(np.bincount(lo, minlength=size) - np.bincount(hi + 1, minlength=size))[:-1] > 0

    def later(self, d: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows whose document is later than the first of their run (rows sorted by document)."""
        return self.same[d] > spread(self.same[d[starts]], starts, len(d))

    # step 3
    def windows(self, answers) -> None:
        if not len(self.starts2):
            self.removed = np.zeros(len(self.buf), bool)
            self.q = self.h = np.zeros(0, U)
            return
        smaller, unsettled = (spread(x, self.starts2, len(self.d)) for x in answers[2])
        flag = smaller | self.later(self.d, self.starts2)
        self.removed = self.covered(self.lo[flag], self.hi[flag])
        q = np.flatnonzero(self.covered(self.lo[unsettled], self.hi[unsettled]) & ~self.removed)
        h = np.full(len(q), U(0xC2B2AE3D27D4EB4F))
        for k in (*range(0, SPAN - 8, 8), SPAN - 8):
            h = mix(h ^ self.words[q + k])
        order = np.lexsort((q, h))
        self.q, self.h = q[order], h[order]
        self.starts3 = run_starts(self.h) if len(q) else np.zeros(0, np.int64)

    def ask_windows(self, home: int, answers) -> pa.Table:
        self.sample()
        self.contexts(answers)
        self.windows(answers)
        if not len(self.q):
            return ASK_SCHEMA.empty_table()
        h = self.h[self.starts3]
        return self.lists(3, home, self.bucket(h), h, self.ids[self.doc(self.q[self.starts3])].astype("<i8"))

    def removed_bytes(self, answers) -> np.ndarray:
        """Mask over the bytes of all documents in order."""
        self.sample()
        self.contexts(answers)
        self.windows(answers)
        removed = self.removed
        if len(self.q):
            removed[self.q[spread(answers[3][0], self.starts3, len(self.q)) | self.later(self.doc(self.q), self.starts3)]] = True
        q = np.flatnonzero(removed)
        return self.covered(q, q + SPAN - 1)[PAD : PAD + self.n]


def answer(kind: int):
    """For one range of names: what each home asked, answered in the order it asked."""

    def sorted_union(asks):
        homes, sizes, bodies = asks.column("home").to_pylist(), asks.column("n").to_pylist(), asks.column("body").to_pylist()
        kinds = {1: ("<u4", "u1"), 2: ("<u4", "<u4", "<u2", "<i8"), 3: ("<u8", "<i8")}[kind]
        columns = [np.concatenate(c) for c in zip(*([np.cumsum(x[0], dtype=x[0].dtype), *x[1:]] for x in (unpack(b, n, *kinds) for b, n in zip(bodies, sizes, strict=True))), strict=True)]
        return homes, sizes, columns

    def run(asks: pa.Table) -> pa.Table:
        homes, sizes, columns = sorted_union(asks)
        name, n = columns[0], len(columns[0])
        bits = []
        if kind == 1:
            order = np.argsort(name, kind="stable")
            starts = run_starts(name[order])
            repeated = np.zeros(n, bool)
            many = np.diff(np.append(starts, n)) > 1
            repeated[order] = spread(many | (np.maximum.reduceat(columns[1][order], starts) > 0), starts, n)
            bits = [repeated]
        else:
            context = columns[1].astype(U) | columns[2].astype(U) << U(32) if kind == 2 else np.zeros(n, U)
            doc = columns[-1]
            order = np.lexsort((doc, context, name))
            starts = run_starts(name[order], context[order])
            smaller = np.zeros(n, bool)
            smaller[order] = spread(doc[order][starts], starts, n) < doc[order]
            bits = [smaller]
            if kind == 2:
                groups = run_starts(name[order])
                contexts = np.add.reduceat(np.isin(np.arange(n), starts).astype(np.int64), groups)
                unsettled = np.zeros(n, bool)
                unsettled[order] = spread(contexts > 1, groups, n)
                bits.append(unsettled)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        bodies = [b"".join(np.packbits(x[a:b]).tobytes() for x in bits) for a, b in zip(edges, edges[1:], strict=False)]
        k = len(homes)
        return pa.table([pa.array(homes, pa.int32()), np.full(k, kind, np.int32), asks.column("bucket").combine_chunks(), pa.array(sizes, pa.int32()), pa.array(bodies, pa.binary())], schema=ANSWER_SCHEMA)

    return run


def answers_of(rows: pa.Table) -> dict[int, list[np.ndarray]]:
    """kind -> bit columns in the order the home asked: by bucket."""
    out: dict[int, list] = {1: [[]], 2: [[], []], 3: [[]]}
    order = sorted(zip(rows.column("kind").to_pylist(), rows.column("bucket").to_pylist(), rows.column("n").to_pylist(), rows.column("body").to_pylist(), strict=True), key=lambda r: r[:2])
    for kind, _, n, body in order:
        width = -(-n // 8)
        for i, column in enumerate(out[kind]):
            column.append(np.unpackbits(np.frombuffer(body, np.uint8, width, i * width), count=n).astype(bool))
    return {k: [np.concatenate(c) if c else np.zeros(0, bool) for c in v] for k, v in out.items()}


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs``. With
    ``with_text``: instead the rows themselves, text replaced by what is left of it (bytes
    of characters cut in two are left out)."""
    schema = docs.schema
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    homes = max(256, total >> 26)
    buckets = max(128, homes)
    filler = "_" * (1 + max(map(len, schema.names)))  # longer than any name; a struct needs a field
    own = packed([c for c in schema.names if c not in ("doc_id", "text")], F.lit(0).alias(filler)) if with_text else F.lit(0)
    text = F.col("text").cast("string")
    dealt = docs.select(F.pmod(F.xxhash64(F.col("doc_id"), F.octet_length(text)), F.lit(homes)).cast("int").alias("home"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), own.alias("own"))

    def home_id(rows):
        return rows.column("home")[0].as_py()

    def names(rows: pa.Table) -> pa.Table:
        return Home(rows, buckets).ask_names(home_id(rows))

    def contexts(rows: pa.Table, answers: pa.Table) -> pa.Table:
        return Home(rows, buckets).ask_contexts(home_id(rows), answers_of(answers)) if rows.num_rows else ASK_SCHEMA.empty_table()

    def windows(rows: pa.Table, answers: pa.Table) -> pa.Table:
        return Home(rows, buckets).ask_windows(home_id(rows), answers_of(answers)) if rows.num_rows else ASK_SCHEMA.empty_table()

    def result(rows: pa.Table, answers: pa.Table) -> pa.Table:
        home = Home(rows, buckets)
        removed = home.removed_bytes(answers_of(answers)) if home.n else np.zeros(0, bool)
        flat, edges = home.buf[PAD : PAD + home.n], home.edges - PAD
        ids, out = home.rows.column("doc_id"), []
        texts = []
        for a, b in zip(edges, edges[1:], strict=False):
            gone = removed[a:b]
            left = flat[a:b][~gone].tobytes()
            if with_text:
                texts.append(left.decode("utf-8", "ignore"))
            else:
                out.append((int(b - a), int(gone.sum()), int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0])), hashlib.sha256(left).hexdigest()))
        if with_text:
            whole = home.rows.column("text").is_null().to_pylist()
            return pa.table({"doc_id": ids, "text": pa.array([None if w else t for w, t in zip(whole, texts, strict=True)], pa.string()), "own": home.rows.column("own")})
        columns = list(zip(*out, strict=True))
        return pa.table({"doc_id": ids, "n_bytes": pa.array(columns[0], pa.int64()), "n_removed": pa.array(columns[1], pa.int64()), "n_spans": pa.array(columns[2], pa.int64()), "kept_sha256": pa.array(columns[3], pa.string())})

    by_home = dealt.groupBy("home")
    answered = by_home.applyInArrow(names, ASK).groupBy("bucket").applyInArrow(answer(1), ANSWER)
    answered2 = by_home.cogroup(answered.groupBy("home")).applyInArrow(contexts, ASK).groupBy("bucket").applyInArrow(answer(2), ANSWER)
    both = answered.unionByName(answered2)
    answered3 = by_home.cogroup(both.groupBy("home")).applyInArrow(windows, ASK).groupBy("bucket").applyInArrow(answer(3), ANSWER)
    last = by_home.cogroup(both.unionByName(answered3).groupBy("home"))
    if not with_text:
        return last.applyInArrow(result, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    rows = last.applyInArrow(result, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("own", dealt.schema["own"].dataType)]))
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("own").getField(c).alias(c) for c in schema.names])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
