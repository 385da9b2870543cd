"""Operator 8: toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are whole words and, for those of more than ``STEM`` letters, their first ``STEM`` letters
as a second term, which lets forms of one word in any of the languages meet. A few toxic words
in a long text hardly move the cosine of the whole, so a text is asked for in windows of
``WINDOW`` words. Examples are whole labelled texts from a
bounded sample outside the held-out fold (at most ``SAMPLE`` rows of each label by hash,
texts of at most ``LONGEST`` bytes); their unit vectors hold every term they have, none is
screened out, and document frequencies of these terms are counted over all documents.

The examples stand in blocks of an inverted index. Lists of frequent terms are kept as
rows, others as postings; each term has its largest weight per block. For a batch of
windows these give a bound for every block; blocks are visited from the highest bounds on,
for the windows whose k-th best cosine the bound still reaches, so the k nearest of each
window are exact. All examples at the k-th cosine vote. Votes are weighted by cosine and by
how many labelled rows an example stands for; neighbours short of k count as clean. The
``LEADING`` windows with the largest shares of toxic votes speak for their text by their
mean, and the nearest ids of the first are the evidence. Isotonic regression of the labels
of the sample on their own shares (each without itself) turns shares into scores.

What is collected or broadcast is bounded by ``SAMPLE`` and ``LONGEST`` alone. All texts are
read whole, in tasks that hold a few megabytes (a longer text on its own).

Nulls: a null text is empty; a null or unlabelled doc_id is scored but teaches nothing; of
rows with one doc_id in labels the larger label holds, of rows with one doc_id in documents
the smallest text teaches. Texts without a term of the examples have no neighbours and get
the score of share 0. Ties between windows go to the first one. Without labelled rows every
score is 0. An empty table gives no rows. Other columns, whatever their names, are no input.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table, text_batches

SAMPLE = 512
LONGEST = 1 << 16
STEM = 4
WINDOW = 12
LEADING = 2
NEIGHBOURS = 16
BLOCK = 256
#: Windows compared at a time, and ids given as evidence.
BATCH, EVIDENCE = 128, 8
#: Words that a task remembers the numbers of.
REMEMBERED = 300_000
WORDS = re.compile(r"\w+")
SCORED = "doc_id long, held_out boolean, score double, predicted int, share double, evidence array<long>"


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def stem(word: str) -> str | None:
    """The second term of a word; no word has a ``^``."""
    return f"{word[:STEM]}^" if len(word) > STEM else None


def terms_of(text: str | None) -> list[str]:
    words = words_of(text)
    return words + [s for w in words if (s := stem(w))]


def fold() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sample_rows(docs: DataFrame, labels: DataFrame, most: int) -> tuple[list, dict[int, int]]:
    """(doc_id, toxic, text) of the sampled training rows, and labelled rows by label."""
    train = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    train = train.filter(fold() != 0)
    sizes = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    picks = [train.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    ids = staged(picks[0].unionByName(picks[1]), "toxic-sample")
    rows = texts_of(docs).join(F.broadcast(ids), "doc_id")  # at most 2 * most ids
    rows = rows.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return sorted(rows.select("doc_id", "toxic", "text").collect(), key=lambda r: r.doc_id), sizes


class Numbers(dict):
    """word -> numbers of those of its terms that are known, remembered for each word met."""

    def __init__(self, known: dict[str, int]):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = (self.known.get(word), self.known.get(stem(word)) if len(word) > STEM else None)
        value = self[word] = tuple(i for i in found if i is not None)
        return value


class Pairs(dict):
    """word -> its row in ``table()``, which has the numbers of its two terms, -1 where no
    example has them."""

    def __init__(self, known: dict[str, int]):
        super().__init__()
        self.known, self.rows = known, []

    def __missing__(self, word: str) -> int:
        self.rows.append((self.known.get(word, -1), self.known.get(stem(word), -1) if len(word) > STEM else -1))
        value = self[word] = len(self.rows) - 1
        return value

    def table(self) -> np.ndarray:
        return np.array(self.rows, np.int64).reshape(-1, 2)

    def clear(self) -> None:
        super().clear()
        self.rows.clear()


def frequencies(docs: DataFrame, number) -> tuple[int, np.ndarray]:
    """Number of all documents, and of those with each word (``number``: a broadcast dict)."""
    m = len(number.value)

    def run(batches):
        known, seen, n = number.value, np.zeros(m + 1, np.int64), 0
        numbers = Numbers(known)
        for batch in text_batches(batches):
            texts = batch.column(0).to_pylist()
            n += len(texts)
            for text in texts:
                held = {t for w in set(words_of(text)) for t in numbers[w]}
                seen[np.fromiter(held, np.int64, len(held))] += 1
            if len(numbers) > REMEMBERED:
                numbers.clear()
        keys = np.flatnonzero(seen[:m])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(keys, m)), pa.array(np.append(seen[keys], n))], ["word", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word long, n long")
    got = rows.groupBy("word").agg(F.sum("n").alias("n")).toArrow()  # one row a word of the sample
    out = np.zeros(m + 1, np.int64)
    out[got.column("word").to_numpy()] = got.column("n").to_numpy()
    return int(out[m]), out[:m]


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(counts)) * idf
    return w / np.linalg.norm(w) if len(w) else w


class BlockMaxIndex:
    """Inverted lists over blocks of examples with each word's largest weight a block.
    ``vectors``: words and unit weights of each example; ``idf``: weights of query words."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, block: int = BLOCK):
        self.order = np.array(sorted(range(len(vectors)), key=lambda i: len(vectors[i][0])), np.int64)
        self.n, self.block = len(vectors), block
        self.blocks = -(-self.n // block)
        self.width = self.blocks * block
        example = np.concatenate([np.full(len(vectors[i][0]), at) for at, i in enumerate(self.order)] or [np.zeros(0, np.int64)]).astype(np.int64)
        word = np.concatenate([vectors[i][0] for i in self.order] or [np.zeros(0, np.int64)]).astype(np.int64)
        weight = np.concatenate([vectors[i][1] for i in self.order] or [np.zeros(0)]) * idf[word]
        size = np.bincount(word, minlength=len(idf))
        frequent = np.flatnonzero(size > max(8, self.n // 16))
        self.row = np.full(len(idf), -1)
        self.row[frequent] = np.arange(len(frequent))
        dense = self.row[word] >= 0
        rows = np.zeros((len(frequent) + 1, self.width), np.float32)  # the last one stays empty
        rows[self.row[word[dense]], example[dense]] = weight[dense]
        self.rows = [np.ascontiguousarray(rows[:, b * block : (b + 1) * block]) for b in range(self.blocks)]
        self.top = np.array([r.max(axis=1) for r in self.rows], np.float32).reshape(self.blocks, len(rows)).T.copy()
        by = np.lexsort((example[~dense], word[~dense]))
        self.example, self.weight = example[~dense][by], weight[~dense][by].astype(np.float32)
        self.start = np.searchsorted(word[~dense][by], np.arange(len(idf) + 1))

    def cosines(self, words: np.ndarray, window: np.ndarray, n: int, k: int, own: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """For n windows (``words`` and the window of each): cosines with all examples, up
        to each window's own norm (-inf in blocks that can't hold one of the k largest and
        for example ``own``), and the k-th of them."""
        frequent = self.row[words] >= 0
        # windows by falling number of frequent terms: the i-th of them adds to the first few only
        sizes = np.bincount(window[frequent], minlength=n)
        order = np.argsort(-sizes, kind="stable")
        place_of = np.empty(n, np.int64)
        place_of[order] = np.arange(n)
        window = place_of[window]
        # the rows of each window's frequent terms, side by side; no matrix product, as its
        # threads would wait for one another within a task
        of = window[frequent]
        rows_of = self.row[words[frequent]]
        by = np.argsort(of, kind="stable")
        of, rows_of = of[by], rows_of[by]
        slots = np.zeros((int(sizes.max(initial=0)), n), np.int64)
        slots[np.arange(len(of)) - np.searchsorted(of, of), of] = rows_of
        upto_slot = [int(np.count_nonzero(sizes > j)) for j in range(len(slots))]
        rare, where = words[~frequent], window[~frequent]
        size = self.start[rare + 1] - self.start[rare]
        upto = np.cumsum(size)
        posting = np.repeat(self.start[rare] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)
        at = np.repeat(where * self.width, size) + self.example[posting]
        base = np.bincount(at, self.weight[posting], n * self.width).astype(np.float32).reshape(n, self.blocks, self.block)
        bounds = base.max(axis=2)
        for slot, m in zip(slots, upto_slot, strict=True):
            bounds[:m] += self.top[slot[:m]]
        bounds *= np.float32(1.0001)
        out = np.full((n, self.width), -np.inf, np.float32)
        best = np.full((n, k), -np.inf, np.float32)
        for b in np.argsort(-bounds.sum(axis=0), kind="stable").tolist():
            go = np.flatnonzero(bounds[:, b] >= best[:, 0])
            if not len(go):
                continue
            s = base[go, b]
            for slot, m in zip(slots, upto_slot, strict=True):
                m = int(np.searchsorted(go, m))
                s[:m] += np.take(self.rows[b], slot[go[:m]], axis=0)
            a, z = b * self.block, min(self.n, (b + 1) * self.block)
            s[:, z - a :] = -np.inf
            if a <= own < z:
                s[:, own - a] = -np.inf
            out[go, a : a + self.block] = s
            better = s.max(axis=1) > best[go, 0]
            go, s = go[better], s[better]
            best[go] = np.partition(np.concatenate([best[go], s], axis=1), self.block, axis=1)[:, self.block :]
        return out[place_of], best[place_of, 0]


class Scorer:
    """Shares of toxic votes and evidence of texts. Built on the driver, used in tasks."""

    def __init__(self, rows: list, sizes: dict[int, int], number: dict[str, int], idf: np.ndarray, k: int):
        vectors = []
        for r in rows:
            counts = Counter(terms_of(r.text))
            keys = np.array([number[w] for w in counts], np.int64)
            vectors.append((keys, unit(np.array(list(counts.values()), np.float64), idf[keys])))
        self.pairs, self.k = Pairs(number), max(1, min(k, len(rows)))
        self.index = BlockMaxIndex(vectors, idf)
        toxic = np.array([r.toxic for r in rows], np.float32)
        have = np.bincount(toxic.astype(np.int64), minlength=2)
        mass = np.array([sizes.get(int(y), 0) / have[int(y)] for y in toxic])
        pad = self.index.width - len(rows)
        self.mass = np.append(mass[self.index.order], np.zeros(pad))
        self.toxic_mass = np.append((mass * toxic)[self.index.order], np.zeros(pad))
        self.ids = np.array([r.doc_id for r in rows], np.int64)[self.index.order]
        self.labels, self.weights = toxic, mass
        self.knots = (np.zeros(1), np.zeros(1))

    def windows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known terms of all texts, the window of each, and the text of each window."""
        numbers = self.pairs
        if len(numbers) > REMEMBERED:
            numbers.clear()
        found, sizes = [], []
        for text in texts:
            words = words_of(text)
            sizes.append(len(words))
            found.extend(map(numbers.__getitem__, words))
        words, sizes = numbers.table()[np.array(found, np.int64)], np.array(sizes, np.int64)
        spans = -(-sizes // WINDOW)
        place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        window = np.repeat(np.cumsum(spans) - spans, sizes) + place // WINDOW
        words, window = words.reshape(-1), np.repeat(window, 2)
        known = words >= 0
        words, window = words[known], window[known]
        which, window = np.unique(window, return_inverse=True)
        return words, window, np.searchsorted(np.cumsum(spans), which, side="right")

    def shares(self, texts: list[str | None], own: int = -1) -> tuple[np.ndarray, list[list[int]]]:
        """Each text's mean share of toxic votes in its leading windows, and the nearest ids
        of the first of them."""
        most, evidence = np.zeros(len(texts)), [[] for _ in texts]
        if not self.index.n:
            return most, evidence
        words, window, text = self.windows(texts)
        shares = np.zeros(len(text))
        edges = np.searchsorted(window, np.arange(0, len(text) + BATCH, BATCH))
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            first, n = i * BATCH, min(BATCH, len(text) - i * BATCH)
            s, kth = self.index.cosines(words[a:b], window[a:b] - first, n, self.k, own)
            voter, example = np.nonzero(s >= np.maximum(kth, np.float32(1e-9))[:, None])
            cosine = s[voter, example].astype(np.float64)
            total, toxic = (np.bincount(voter, cosine * m[example], n) for m in (self.mass, self.toxic_mass))
            ends = np.cumsum(np.bincount(voter, minlength=n))
            toxic = toxic / np.maximum(total, 1e-30) * np.minimum(1, np.diff(ends, prepend=0) / self.k)
            shares[first : first + n] = toxic
            of = text[first : first + n]
            for at, t in self.leading(toxic, of):
                if not evidence[t] or toxic[at] > most[t]:
                    near = slice(ends[at - 1] if at else 0, ends[at])
                    most[t], evidence[t] = toxic[at], self.ids[example[near][np.argsort(-cosine[near], kind="stable")][:EVIDENCE]].tolist()
        order = np.lexsort((-shares, text))
        of = text[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        lead = order[rank < LEADING]
        total, n = (np.bincount(text[lead], w, len(texts)) for w in (shares[lead], None))
        return np.clip(total / np.maximum(n, 1), 0, 1), evidence

    @staticmethod
    def leading(toxic: np.ndarray, of: np.ndarray):
        """(window, text) of the largest share of each text in a batch, the first of ties."""
        order = np.lexsort((np.arange(len(of)), -toxic, of))
        first = order[np.flatnonzero(np.diff(of[order], prepend=-1))]
        return zip(first.tolist(), of[first].tolist(), strict=True)

    def scores(self, shares: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(shares, *self.knots), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on x by pooling adjacent violators."""
    pools: list[list[float]] = []
    for a, b, w in sorted(zip(x.tolist(), y.tolist(), weight.tolist(), strict=True)):
        pools.append([a * w, b * w, w, a, a])
        while len(pools) > 1 and (pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2] or pools[-2][4] == pools[-1][3]):
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2] + last[2], pools[-1][3], last[4]]
    at = [e for p in pools for e in (p[3], p[4])]
    return np.array(at), np.array([p[1] / p[2] for p in pools for _ in (0, 1)])


def fitted(docs: DataFrame, labels: DataFrame, sample: int, k: int) -> Scorer:
    spark = docs.sparkSession
    rows, sizes = sample_rows(docs, labels, sample)
    number = {w: i for i, w in enumerate(sorted({w for r in rows for w in terms_of(r.text)}))}
    known = spark.sparkContext.broadcast(number)  # words of the bounded sample
    n, df = frequencies(docs, known) if number else (0, np.zeros(0))
    scorer = Scorer(rows, sizes, number, np.log((1 + n) / (1 + df)) + 1, k)
    if not rows:
        return scorer
    shared, place = spark.sparkContext.broadcast(scorer), np.argsort(scorer.index.order)

    def own_shares(batches):
        for batch in batches:
            got = [float(shared.value.shares([t], int(place[i]))[0][0]) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], ["i", "share"])

    own = spark.createDataFrame([(i, r.text) for i, r in enumerate(rows)], "i long, text string").repartition(32).mapInArrow(own_shares, "i long, share double").collect()
    shares = np.zeros(len(rows))
    for r in own:
        shares[r.i] = r.share
    scorer.knots = isotonic(shares, scorer.labels, scorer.weights)
    return scorer


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, k: int = NEIGHBOURS) -> DataFrame:
    """doc_id, held_out, score, predicted, share (of toxic votes) and evidence (nearest ids)
    for each row."""
    scorer = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample, k))

    def run(batches):
        own = scorer.value
        for batch in text_batches(batches, 1 << 20):
            shares, evidence = own.shares(batch.column(1).to_pylist())
            scores = own.scores(shares)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(shares), pa.array(evidence, pa.list_(pa.int64()))], ["doc_id", "held_out", "score", "predicted", "share", "evidence"])

    out = texts_of(docs).withColumn("held_out", F.coalesce(fold() == 0, F.lit(False)))
    return out.mapInArrow(run, SCORED)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
