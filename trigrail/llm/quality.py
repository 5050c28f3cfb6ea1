"""Quality classifier: a weak-label model trains a hashed linear scorer.

Heuristic labellers look at a text's statistics and vote bad, good or not at all. Expectation-
maximisation over the counts of all vote patterns in the corpus estimates how often each labeller
gives each vote on good and on bad texts, and with that each pattern's posterior. Posterior labels
of a bounded sample train a logistic scorer of hashed features: words, the kinds of characters of
words, and the statistics in steps. Every text is scored whole, and rejected if its score is below KEEP, unless it
is too short to be voted on and shows no fault.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trigrail.llm import linear, store
from trigrail.llm import text as tx

KEEP, BITS = 0.5, 18
#: Most documents that are fitted of those the votes call rather good, and of the others.
SAMPLE = 2500
#: Characters in words of natural text besides letters, digits and bytes beyond ASCII. Fixed values.
PLAIN = ".,;:!?'\"()-"
#: Frequent words of European languages. Fixed values.
STOP = (
    "the of and to in is that for it was with as on be at by this are or an from a "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur "
    "el los y las por con para se del una su al lo como más o pero sus"
).split()
#: (name of the statistic, bad beyond, good within); a vote needs WORDS words.
LABELLERS = (("symbols", 0.15, 0.02), ("bare", 0.15, 0.05), ("upper", 0.3, 0.15), ("again", 0.1, 0.03), ("commonest", 0.25, 0.15), ("lines", 0.3, 0.1), ("long", 0.1, 0.03), ("shouts", 0.2, 0.05), ("unstopped", 0.96, 0.9))
WORDS = 10
#: Statistics beyond which a text of fewer words shows a fault too; a few words are often unstopped, or one of them common.
SIGNS = {"symbols": 0.15, "bare": 0.15, "upper": 0.5, "again": 0.5, "lines": 0.3, "long": 0.1, "shouts": 0.5}
VOTE_BAD, VOTE_GOOD, NO_VOTE = 0, 1, 2
#: Prior shares of bad votes: of any labeller on good texts, of a fault's own labeller on its texts; the documents that such a prior counts as, whatever the size of the corpus; and texts that are too few for a fault.
ALARM, FAULT, WEIGHT, SEEN = 0.005, 0.9, 1000, 4
STATS = tuple(name for name, *_ in LABELLERS)

KIND = np.full(256, 16, np.uint8)  # of a byte in a word: other signs 16
KIND[[ord(c) for c in PLAIN]] = 8
KIND[ord("0") : ord("9") + 1] = 4
KIND[ord("A") : ord("Z") + 1] = 2
KIND[ord("a") : ord("z") + 1] = 1
KIND[128:] = 1


def _hashes(word_list: list[str]) -> np.ndarray:
    raw = [w.encode() for w in word_list]
    ends = np.cumsum([len(r) for r in raw])
    return tx.word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends)


def statistics(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(statistics [texts, labellers], words of each text, bounds, word hashes, kinds of characters of each word).

    Shares of words (symbols: with unusual signs; bare: without letter or digit; again: equal to the last
    one; commonest; long: over 25 bytes; shouts: ending in !; unstopped: no stop words), of letters (upper),
    of bytes (lines: in repeated lines of 20 bytes or more).
    """
    start, end, bounds = tx.words(data, offs)
    n = np.diff(bounds)
    h = tx.word_hashes(tx.LOWER[data], start, end)
    bare = tx.word_hashes(np.where(np.isin(data, np.frombuffer(PLAIN.encode(), np.uint8)), np.uint8(0), tx.LOWER[data]), start, end) if len(start) else h
    kind = KIND[data]
    kinds = np.bitwise_or.reduceat(kind, start) if len(start) else np.zeros(0, np.uint8)
    if len(start):  # reduceat runs on to the next word: the space between has no kind
        spaced = kind.copy()
        spaced[tx.SPACE[data]] = 0
        kinds = np.bitwise_or.reduceat(spaced, start)
    of = np.repeat(np.arange(len(n)), n)
    share = lambda flag: np.bincount(of, flag, len(n)) / np.maximum(n, 1)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    text_of = np.repeat(np.arange(len(n)), np.diff(offs))
    up, low = np.bincount(text_of, kind == 2, len(n)), np.bincount(text_of, (kind == 1) & (data < 128), len(n))
    common, lines = np.zeros(len(n)), np.zeros(len(n))
    raw = data.tobytes()
    for k in range(len(n)):
        if n[k]:
            common[k] = np.unique(h[bounds[k] : bounds[k + 1]], return_counts=True)[1].max() / n[k]
            every = [x for x in raw[offs[k] : offs[k + 1]].split(b"\n") if len(x) >= 20]
            if len(every) > 1:
                seen: set[bytes] = set()
                lines[k] = sum(len(x) for x in every if x in seen or seen.add(x)) / sum(map(len, every))
    stats = np.stack(
        (share((kinds & 16) > 0), share((kinds & 7) == 0), up / np.maximum(up + low, 1), share(same), common, lines, share(end - start > 25), share(data[end - 1] == ord("!")) if len(end) else share(same), 1 - share(np.isin(h, STOPS) | np.isin(bare, STOPS_BARE))), 1
    )
    return stats, n, bounds, h, kinds


STOPS = _hashes(STOP)
STOPS_BARE = _hashes([w + "\0" for w in STOP] + ["\0" + w for w in STOP])


def votes(stats: np.ndarray, n: np.ndarray) -> np.ndarray:
    """[texts, labellers] of VOTE_BAD, VOTE_GOOD, NO_VOTE."""
    bad, good = (np.array([x[k] for x in LABELLERS]) for k in (1, 2))
    out = np.where(stats > bad, VOTE_BAD, np.where(stats <= good, VOTE_GOOD, NO_VOTE))
    out[n < WORDS] = NO_VOTE
    return out


def exempt(stats: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Texts that stay whatever their score: of too few words for votes, and without a fault's sign, or of a few bare signs."""
    sign = [stats[:, STATS.index(name)] > most for name, most in SIGNS.items()]
    signs = (stats[:, STATS.index("bare")] == 1) & (stats[:, STATS.index("long")] == 0)
    return (n < WORDS) & (signs | ~np.any(sign, axis=0))


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of good by pattern, P(vote | class) [class, labeller, vote], P(class)); class 0 is good.

    Faults don't come together, so bad texts are no single class in which labellers err independently:
    there is a class for each labeller's fault, which starts from the texts that it calls bad. A labeller alone in its votes
    may be noise or a fault of its own, which no count can tell: priors of WEIGHT documents lean to few false alarms, and
    to labellers that see their own fault, and a fault of SEEN texts is no class; beyond that all shares are estimated. Patterns without a vote are good.
    """
    m = patterns.shape[1]
    bad = (patterns == VOTE_BAD).astype(float)
    share = np.concatenate((np.full((len(patterns), 1), 0.1), 0.9 * bad / np.maximum(bad.sum(1, keepdims=True), 1)), 1)
    share[bad.sum(1) == 0] = [0.99, *[0.01 / m] * m]
    for _ in range(rounds):
        like = np.stack([share.T @ ((patterns == v) * counts[:, None]) for v in range(3)], 2) + 0.1
        rest = like[:, :, VOTE_GOOD:].sum(0) / like[:, :, VOTE_GOOD:].sum((0, 2))[:, None]
        like[0] += WEIGHT * np.concatenate((np.full((m, 1), ALARM), rest * (1 - ALARM)), 1)
        like[range(1, m + 1), range(m)] += WEIGHT * np.concatenate((np.full((m, 1), FAULT), rest * (1 - FAULT)), 1)
        like /= like.sum(2, keepdims=True)
        prior = share.T @ counts
        prior[1:] = np.maximum(prior[1:] - SEEN, 0.1)  # a sparse prior: SEEN texts are no class yet
        prior /= prior.sum()
        log = np.log(prior) + np.log(like[:, np.arange(m), patterns]).sum(2).T
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        if np.abs(new - share).max() < 1e-6:
            break
        share = new
    return np.where((patterns == NO_VOTE).all(1), 1.0, share[:, 0]), like, prior


def features(data: np.ndarray, offs: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Hashed features of each text, its votes, and whether it is exempt."""
    stats, n, bounds, h, kinds = statistics(data, offs)
    word = (h >> np.uint64(64 - BITS)).astype(np.int64)
    kind = (tx.mix(kinds.astype(np.uint64) + np.uint64(1 << 40)) >> np.uint64(64 - BITS)).astype(np.int64)
    step = np.minimum(stats * 20, 19).astype(np.uint64) + np.arange(stats.shape[1], dtype=np.uint64) * np.uint64(32)
    step = (tx.mix(step + np.uint64(1 << 41)) >> np.uint64(64 - BITS)).astype(np.int64)
    out = []
    for k in range(len(n)):
        a, b = bounds[k], bounds[k + 1]
        i1, c1 = np.unique(word[a:b], return_counts=True)
        i2, c2 = np.unique(kind[a:b], return_counts=True)
        m = max(b - a, 1)
        out.append((np.concatenate((i1, i2, step[k])), np.concatenate((np.sqrt(c1 / m), np.sqrt(c2 / m), np.full(step.shape[1], 0.5)))))
    return out, votes(stats, n), exempt(stats, n)


def _code(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = tx.buffers(batch.column(1))
        for i, j in tx.steps(offs):
            stats, n, *_ = statistics(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(_code(votes(stats, n)).astype(np.int32))], names=["doc_id", "pattern"])


def _fit(docs: DataFrame, seen: DataFrame, posterior: DataFrame, sample: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the scorer, from a sample of documents with their posterior labels, weighed so that the two kinds keep the corpus's shares."""
    known = seen.join(F.broadcast(posterior), "pattern")  # at most 3 ** labellers patterns
    n = {r.high: r["count"] for r in known.groupBy((F.col("good") >= 0.5).alias("high")).count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1_000_000)) / 1e6  # the expected number is bounded
    most = F.when(F.col("good") >= 0.5, sample / n.get(True, 1)).otherwise(sample / n.get(False, 1))
    chosen = store.sized(store.written(known.where(draw < most).select("doc_id", "good"), "sample"))
    rows = docs.join(chosen, "doc_id").select("doc_id", "good", F.lit(0).alias("all"), "text")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        data, offs = tx.buffers(table.column("text"))
        x = [f for i, j in tx.steps(offs) for f in features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])[0]]
        good = table.column("good").to_numpy()
        have, corpus = np.bincount(good >= 0.5, minlength=2), np.array([n.get(False, 0), n.get(True, 0)])
        weight = corpus / corpus.sum() / np.maximum(have, 1) * len(good)
        w, bias = linear.train(x, good, weight[(good >= 0.5).astype(int)], 1 << BITS, rate=0.3)
        return pa.table({"w": pa.array([w.astype("<f4").tobytes()], pa.binary()), "bias": [float(bias)]})

    model = store.written(rows.groupBy("all").applyInArrow(tx.lean(run), "w binary, bias double"), "model").first()
    return (np.frombuffer(model.w, "<f4"), model.bias) if model else (np.zeros(1 << BITS, np.float32), 1.0)


def quality(docs: DataFrame, *, keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """One row per document: posterior (of good, by the votes), score (of the scorer, 0 to 1), kept.

    docs: doc_id, text; other columns are ignored. Kept are texts of a score of keep at least, and those
    of under WORDS words without a sign of a fault, or of bare signs only (exempt). Texts of under WORDS words, null and empty ones
    get no votes and posterior 1; those without a word have score 1 too. Rows of equal doc_id: see store.keyed.
    """
    docs = store.keyed(docs)
    spark = docs.sparkSession
    seen = store.written(docs.mapInArrow(tx.lean(_patterns), "doc_id long, pattern int"), "votes")
    counted = seen.groupBy("pattern").count().collect()  # at most 3 ** labellers rows
    codes = np.array([r.pattern for r in counted], np.int64)
    patterns = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    good = label_model(patterns, np.array([r["count"] for r in counted], float))[0] if counted else np.zeros(0)
    posterior = spark.createDataFrame(list(zip(codes.tolist(), good.tolist(), strict=True)), T.StructType([T.StructField("pattern", T.IntegerType()), T.StructField("good", T.DoubleType())]))
    sent = spark.sparkContext.broadcast((_fit(docs, seen, posterior, sample), dict(zip(codes.tolist(), good.tolist(), strict=True))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (w, bias), by_votes = sent.value
        for batch in batches:
            data, offs = tx.buffers(batch.column(1))
            for i, j in tx.steps(offs):
                x, v, stays = features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                score = linear.sigmoid(np.array([float(w[f] @ val) for f, val in x]) + bias)
                score[[len(f) == len(LABELLERS) for f, _ in x]] = 1.0
                post = np.array([by_votes[c] for c in _code(v).tolist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(post), pa.array(score), pa.array((score >= keep) | stays)], names=["doc_id", "posterior", "score", "kept"])

    return docs.mapInArrow(tx.lean(run), "doc_id long, posterior double, score double, kept boolean")
