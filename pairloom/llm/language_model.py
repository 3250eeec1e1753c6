"""Language-model scores by a weighted backoff automaton learnt from the corpus.

The model is a smoothed trigram model. Its states are the pairs of words and the words that occur
as histories, and one root. A seen trigram t u w is an arc of state (t, u), a seen bigram u w an
arc of state u, a word an arc of the root. State (t, u) has a failure arc to u, u one to the root,
each with a backoff weight. A text is scored by one traversal from left to right, which starts in
the state of the beginning: a step follows failure arcs until its state has an arc for the word
(up to two; a word that the root does not know is its event "unknown"), adds up the log weights,
and the arc leads to the state of the longest known history, where the next step starts.

  P(w)       = (c(w) - D) / N, and D V / N for the one event "unknown"; D = n1 / (n1 + 2 n2), or
               0.5 where no word occurs twice, as D = 1 would make words that occur once impossible
  P(w | u)   = (c(u w) + k P(w)) / (c(u) + k), k = c(u) ** beta1
  P(w | t u) = (c(t u w) + k P(w | u)) / (c(t u) + k), k = c(t u) ** beta2

k is the expected number of different words after a history. Each beta is fitted so that these
add up to the number of different n-grams that are one word longer, counted over the whole corpus.

Counts and model never stand in one place. Texts are packed into chunks of a few megabytes and
stored. Each chunk asks for its different words, bigrams and trigrams: sorted hashes, cut into
buckets by value, as compressed blobs. A bucket adds up the counts of all chunks and answers each
with the totals in its own order; answers meet their chunk again for scoring. What moves is each
chunk's different n-grams once, a few bytes each, however frequent they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm import kernels
from pairloom.llm.chunks import (
    bucket_count,
    bucket_ends,
    by_chunk,
    chunk_bytes,
    pack,
    pack_sorted,
    spare_bits,
    text_chunks,
    unpack,
    unpack_sorted,
    without_bits,
)
from pairloom.session import materialize

CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
BETAS = np.linspace(0.3, 1.0, 57)
# Hashes of the beginning and the end of a text.
BEGIN = np.uint64(0x517CC1B727220A95)
END = np.uint64(0x2545F4914F6CDD1D)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
# N-grams by their length, as named in the tables of requests and answers.
ORDERS = ("words", "pairs", "triples")
BUCKETS_A_TASK = 2
CHUNKS_A_TASK = 4


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, their histories, and the text of each token."""
    words, of_text = kernels.word_hashes(data, at)
    counts = np.diff(of_text)
    n = len(counts)
    text = np.repeat(np.arange(n), counts + 1)
    ends = np.cumsum(counts + 1) - 1
    token = np.full(len(text), END)
    is_word = np.ones(len(text), bool)
    is_word[ends] = False
    token[is_word] = words
    history = np.concatenate([[BEGIN], token[:-1]]) if n else token
    history[ends - counts] = BEGIN
    return token, history, text


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows one by one: a row holds a chunk, so a task holds one decoded chunk at a time."""
    for i in range(batch.num_rows):
        yield from batch.slice(i, 1).to_pylist()


def ngrams(
    token: np.ndarray, history: np.ndarray, drop_bits: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the pairs, which steps have two words before them, and keys of their triples.

    Keys are hashes without their lowest bits; the lowest bit kept of a pair tells whether it ends
    a text, as such a pair is no history.
    """
    whole = kernels.mix(history * FACTOR + token)
    ends = (token == END).astype(np.uint64) << np.uint64(drop_bits)
    pairs = without_bits(whole, drop_bits + 1) | ends
    inner = np.flatnonzero(history != BEGIN)
    return pairs, inner, without_bits(kernels.mix(whole[inner - 1] * FACTOR + token[inner]), drop_bits)


def ends_text(pairs: np.ndarray, drop_bits: int) -> np.ndarray:
    return (pairs >> np.uint64(drop_bits)) & np.uint64(1) == 1


def requests(chunks: DataFrame, buckets: int) -> DataFrame:
    """bucket, chunk, and per order keys and counts: those of the learning texts.

    A chunk sends nothing to a bucket that holds none of its n-grams.
    """
    low_bits = spare_bits(buckets)
    names = [f"{order}{part}" for order in ORDERS for part in ("", "_counts")]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                token, history, text = tokens(*chunk_bytes(row["data"], row["sizes"]))
                learn = np.array(row["marks"], float)[text]
                pairs, inner, triples = ngrams(token, history, low_bits)
                sides = []
                for keys, weights in ((token, learn), (pairs, learn), (triples, learn[inner])):
                    distinct, which = np.unique(keys, return_inverse=True)
                    counts = np.bincount(which, weights=weights, minlength=len(distinct))
                    ends = [0, *bucket_ends(distinct, buckets).tolist()]
                    sides.append((distinct, counts.astype(np.uint64), ends))
                cells: list[list] = [[] for _ in range(2 + len(names))]
                for bucket in range(buckets):
                    own = [slice(ends[bucket], ends[bucket + 1]) for _, _, ends in sides]
                    if all(o.start == o.stop for o in own):
                        continue
                    blobs = []
                    for (distinct, counts, _), o in zip(sides, own, strict=True):
                        blobs += [pack_sorted(distinct[o]), pack(counts[o])]
                    for cell, value in zip(cells, (bucket, row["chunk"], *blobs), strict=True):
                        cell.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells[0], pa.int32()), pa.array(cells[1], pa.int64()),
                     *[pa.array(c, pa.binary()) for c in cells[2:]]],
                    ["bucket", "chunk", *names],
                )

    return chunks.select("chunk", "marks", "sizes", "data").mapInArrow(
        asked, "bucket int, chunk long, " + ", ".join(f"{n} binary" for n in names)
    )


def _totals(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Different keys, their summed counts, and the sums in the order of each asker."""
    asked = [unpack_sorted(k) for k in keys]
    ends = np.cumsum([len(a) for a in asked])[:-1]
    asked = np.concatenate(asked)
    distinct, which = np.unique(asked, return_inverse=True)
    del asked
    given = np.concatenate([unpack(c) for c in counts]).astype(np.float64)
    total = np.bincount(which, weights=given, minlength=len(distinct))
    return distinct, total, [pack(t.astype(np.uint64)) for t in np.split(total[which], ends)]


def _powers(counts: np.ndarray) -> np.ndarray:
    """For each of BETAS the sum of the counts to that power."""
    values, times = np.unique(counts, return_counts=True)
    return (values[:, None] ** BETAS * times[:, None]).sum(axis=0)


def answers(asked: DataFrame, buckets: int) -> DataFrame:
    """bucket, chunk and per order counts: totals for each asker; stats: one row a bucket.

    stats holds the tokens, the different words, those that occur once and twice, the texts, the
    different bigrams and trigrams, and for each of BETAS the sum of c ** beta over all histories
    of one word (with the beginning) and of two words.
    """
    low_bits = spare_bits(buckets)
    names = [f"{order}_counts" for order in ORDERS]

    def summed(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        chunk = group.column("chunk").to_pylist()
        given, found = [], []
        for order in ORDERS:  # one after the other: of triples, the most, only the number is kept
            blobs = (group.column(c).to_pylist() for c in (order, f"{order}_counts"))
            distinct, total, answer = _totals(*blobs)
            given.append(answer)
            learnt = total > 0
            found.append((distinct[learnt], total[learnt]) if order != "triples" else learnt.sum())
            del distinct, total, learnt
        (words, word_totals), (pairs, pair_totals), n_triples = found
        stats = [
            float(word_totals.sum()),
            float(len(words)),
            float(np.count_nonzero(word_totals == 1)),
            float(np.count_nonzero(word_totals == 2)),
            # As histories, the end of texts stands for their beginning: both occur once a text.
            float(word_totals[words == END].sum()),
            float(len(pairs)),
            float(n_triples),
            *_powers(word_totals).tolist(),
            *_powers(pair_totals[~ends_text(pairs, low_bits)]).tolist(),
        ]
        n = len(chunk)
        columns = {
            "bucket": pa.array([bucket] * (n + 1), pa.int32()),
            "chunk": pa.array([*chunk, None], pa.int64()),
        }
        columns |= {c: pa.array([*a, None], pa.binary()) for c, a in zip(names, given, strict=True)}
        columns["stats"] = pa.array([None] * n + [stats], pa.list_(pa.float64()))
        return pa.table(columns)

    # Neighbouring buckets share a task: what one reads neither grows with the input nor by chance.
    tasks = -(-buckets // BUCKETS_A_TASK)
    return (
        asked.withColumn("task", F.expr(f"CAST(bucket DIV {BUCKETS_A_TASK} AS int)"))
        .repartitionById(tasks, "task")
        .groupBy("task", "bucket")
        .applyInArrow(
            summed,
            "bucket int, chunk long, " + "".join(f"{n} binary, " for n in names) + "stats array<double>",
        )
    )


class Smoothing:
    """The numbers of the whole corpus that turn counts into weights."""

    def __init__(self, stats: np.ndarray | None):
        n = len(BETAS)
        stats = np.zeros(7 + 2 * n) if stats is None else stats
        self.tokens, self.words, once, twice, self.texts, pairs, triples = stats[:7]
        self.discount = once / (once + 2 * twice) if once and twice else 0.5
        self.betas = [
            float(np.interp(longer, sums, BETAS)) if longer else 1.0
            for longer, sums in ((pairs, stats[7 : 7 + n]), (triples, stats[7 + n :]))
        ]

    def root(self, count: np.ndarray) -> np.ndarray:
        """P(w) of words with these counts; 0 is the event of an unknown word."""
        if not self.tokens:
            return np.ones(len(count))
        known = count - self.discount
        return np.where(count > 0, known, self.discount * self.words) / self.tokens

    def failure(self, order: int, history: np.ndarray) -> np.ndarray:
        """Backoff weight of states of ``order`` words that occur ``history`` times."""
        expected = history ** self.betas[order - 1]
        return expected / (history + expected)

    def arc(self, order: int, count: np.ndarray, history: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Weight of the arcs of such states; ``lower`` is the word's weight one state further."""
        expected = history ** self.betas[order - 1]
        return (count + expected * lower) / (history + expected)


def traverse(
    smoothing: Smoothing,
    word: np.ndarray,
    history: np.ndarray,
    pair: np.ndarray,
    context: np.ndarray,
    triple: np.ndarray,
) -> np.ndarray:
    """log10 weight of each step of the traversal.

    The state that a step starts in is the one its predecessor's arc led to: two words if they
    are a seen pair (``context`` counts it), else the last word if it is known (``history``), else
    the root, with both 0. ``word``, ``pair`` and ``triple`` count the step's n-grams: an arc exists
    where the count is not 0. All steps follow their failure arcs at once, an order at a time.
    """
    state = np.where(context > 0, 2, np.where(history > 0, 1, 0))
    root = smoothing.root(word)
    counts = {1: (pair, history), 2: (triple, context)}
    # The word's weight from the state of one word on, which arcs of two words are mixed with.
    inner = root.copy()
    has = (history > 0) & (pair > 0)
    inner[has] = smoothing.arc(1, pair[has], history[has], root[has])
    lower = {1: root, 2: inner}
    weight, open_ = np.ones(len(word)), np.ones(len(word), bool)
    for order in (2, 1):
        count, seen = counts[order]
        stands = open_ & (state == order)
        arcs, fails = stands & (count > 0), stands & (count == 0)
        weight[arcs] *= smoothing.arc(order, count[arcs], seen[arcs], lower[order][arcs])
        weight[fails] *= smoothing.failure(order, seen[fails])
        open_[arcs] = False
        # The state one word shorter is known whenever the longer one is.
        state[fails] = order - 1
    weight[open_] *= root[open_]
    return np.log10(weight)


def _scored(chunks: DataFrame, answered: DataFrame, buckets: int, smoothing: Smoothing) -> DataFrame:
    low_bits = spare_bits(buckets)
    base_total = smoothing.tokens + smoothing.words + 1
    columns = [f"{order}_counts" for order in ORDERS]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                token, history, text = tokens(*chunk_bytes(row["data"], row["sizes"]))
                found = sorted(row["answers"], key=lambda a: a["bucket"])
                pairs, inner, triples = ngrams(token, history, low_bits)
                per_step = []
                for column, keys in zip(columns, (token, pairs, triples), strict=True):
                    totals = np.concatenate([unpack(a[column]) for a in found]).astype(np.float64)
                    _, at = np.unique(keys, return_inverse=True)
                    per_step.append(totals[at])
                count, pair, inner_triple = per_step
                before, context, triple = (np.zeros(len(token)) for _ in range(3))
                before[:] = smoothing.texts
                before[inner], context[inner] = count[inner - 1], pair[inner - 1]
                triple[inner] = inner_triple
                steps = traverse(smoothing, count, before, pair, context, triple)
                n = len(row["sizes"])
                per_text = lambda x: np.bincount(text, weights=x, minlength=n)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array([not x for x in row["marks"]], pa.bool_()),
                        pa.array(np.bincount(text, minlength=n)),
                        pa.array(per_text(count > 0).astype(np.int64)),
                        pa.array(np.full(n, int(smoothing.tokens))),
                        pa.array(per_text(np.log10((count + 1) / base_total))),
                        pa.array(per_text(steps)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    per_chunk = by_chunk(answered, columns, CHUNKS_A_TASK)
    return (
        chunks.select("chunk", "doc_ids", "marks", "sizes", "data")
        .join(per_chunk, "chunk")
        .mapInArrow(
            scored,
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
            "base_score double, score double",
        )
    )


def score_texts(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (both log10 probabilities of the whole text).

    The model learns from the texts whose crc32(doc_id as text) modulo ``folds`` is not ``held``;
    a null id counts as learning. A-Z are folded; tokens are the words and one end, so a null or
    empty text has one token. Repeated rows count and are scored each; other columns are left
    out; an empty table gives an empty result. Without any learning text only "unknown" is
    possible and every score is 0.
    """
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    chunks = text_chunks(docs, CHUNK_BYTES, F.coalesce(remainder != held, F.lit(True)))
    buckets = bucket_count(chunks, BUCKET_BYTES)
    answered = materialize(answers(requests(chunks, buckets), buckets), "answers")
    stats = (
        answered.where("stats IS NOT NULL")
        .select(F.posexplode("stats").alias("place", "value"))
        .groupBy("place")
        .agg(F.sum("value").alias("value"))
        .orderBy("place")
        .collect()
    )
    smoothing = Smoothing(np.array([r["value"] for r in stats]) if stats else None)
    return _scored(chunks, answered, buckets, smoothing)
