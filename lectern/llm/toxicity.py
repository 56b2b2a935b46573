"""Toxicity by weak supervision: voters of several kinds, a generative label model with pair potentials, a linear classifier."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, materialize

#: Parameters of the classifier and its lexicon: rows that it is fitted on, the first by a hash of doc_id; terms of the lexicon, the best by odds
#: and support; buckets that words are hashed to.  Every word counts through its bucket, in the lexicon or not.
MOST_FIT, MOST_TERMS, BUCKETS = 20_000, 20_000, 2048
#: Labels that are broadcast at most (12 bytes each); beyond that texts shuffle to meet them.
MOST_BROADCAST = 1_000_000
#: Common insults by language.
INSULTS = {
    "english": "idiot idiots imbecile moron moronic stupid dumb dumbass scum trash loser losers clown pathetic worthless disgusting jerk bastard bitch asshole retard scumbag",
    "german": "idiot idioten trottel depp dumm dummkopf arschloch schwachkopf abschaum versager miststück wichser drecksau vollidiot hurensohn",
    "french": "idiot idiote imbécile crétin connard connasse salaud salope débile abruti ordure enculé minable raclure",
    "spanish": "idiota imbécil estúpido estúpida tonto cabrón gilipollas basura escoria payaso inútil pendejo puta mierda",
}
SECOND = frozenset("you your yours youre u du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti eres usted vosotros".split())
#: Prefix lengths of pattern terms, written `prefix*`.
PREFIXES = (5, 6, 7, 8)
#: The voters, in the order of their bits: lexicons by language, learned words by their log odds, learned prefixes by length, an insult near the
#: second person, an insult said three times, an insult with letters masked, shouting, and one per cent of insults.
VOTERS = (*INSULTS, "strong", "medium", "weak", "stems", "long stems", "address", "repeated", "masked", "shout", "density")
STRONG, MEDIUM, LEAST = float(np.log(30)), float(np.log(15)), float(np.log(8))
THRESHOLD = 0.3
#: Bounds of a person's chance to call a clean and a toxic text toxic.
ERRS = ((0.001, 0.9), (0.02, 0.999))
_WORD = re.compile(r"[^\W\d_]+")
_MARK = re.compile(r"[0-9@$*]")
_MASKED = re.compile(r"(?<![^\W_])[^\W\d_]++[0-9@$!*][\w@$!*]*")
_PLAIN = str.maketrans("0134567@$!", "oieasgtasi")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id's text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def terms_of(word: str) -> list[str]:
    return [word, *[word[:k] + "*" for k in PREFIXES if len(word) > k]]


def learn_lexicon(rows: DataFrame) -> list[tuple[str, float]]:
    """Terms that mark toxic texts, best first: (term, log odds).

    rows: text and toxic of all documents with a label.  A term is a word or a
    prefix; it needs five toxic documents and odds eight times those of clean
    ones.  Tasks count their own documents first; at most MOST_TERMS rows
    reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[toxic].update({t for w in set(_WORD.findall((text or "").lower())) for t in terms_of(w)})
                if len(seen[toxic]) > 1_000_000:
                    yield part(toxic, seen[toxic])
                    seen[toxic].clear()
        for toxic, c in seen.items():
            yield part(toxic, c)

    def part(toxic: int, c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"term": list(c), "toxic": [toxic] * len(c), "n": list(c.values())}, schema=schema)

    schema = pa.schema([("term", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())])
    of = lambda x: F.sum(F.when(F.col("toxic") == x, F.col("n")).otherwise(0))
    total = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    odds = lambda n, x: (F.col(n) + 0.5) / (total.get(x, 0) + 1)
    counted = rows.mapInArrow(count, "term string, toxic int, n bigint").groupBy("term").agg(of(1).alias("bad"), of(0).alias("good"))
    log_odds = F.log(odds("bad", 1) / odds("good", 0))
    best = counted.where(F.col("bad") >= 5).withColumn("odds", log_odds).where(F.col("odds") >= LEAST)
    best = best.orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "term").limit(MOST_TERMS)
    return [(r.term, r.odds) for r in best.collect()]


class Voters(dict):
    """Votes on texts as bits.

    What a word says is remembered up to a bound: its bucket, and (language
    bits, tier, short stems, long stems) or () for most.
    """

    def __init__(self, learned: list[tuple[str, float]]):
        super().__init__()
        self.odds = dict(learned)
        self.lists = [frozenset(words.split()) for words in INSULTS.values()]
        self.curated = frozenset().union(*self.lists)

    def __missing__(self, word: str) -> tuple[int, tuple[int, ...]]:
        if len(self) > 400_000:
            self.clear()
        said = self.odds.get(word, 0.0)
        tier = 3 if said >= STRONG else 2 if said >= MEDIUM else 1 if said >= LEAST else 0
        stems = [word[:k] + "*" in self.odds for k in PREFIXES if len(word) > k] + [False] * 4
        info = (sum(1 << i for i, words in enumerate(self.lists) if word in words), tier, int(any(stems[:2])), int(any(stems[2:])))
        self[word] = found = (zlib.crc32(word.encode()) % BUCKETS, info if any(info) else ())
        return found

    def _masked(self, low: str) -> bool:
        if "!" not in low and not _MARK.search(low):
            return False
        for m in _MASKED.finditer(low):
            plain = m.group(0).translate(_PLAIN)
            if plain in self.curated or "*" in plain and any(re.fullmatch(re.escape(plain).replace(r"\*", "."), w) for w in self.curated if len(w) == len(plain)):
                return True
        return False

    def read(self, text: str | None) -> tuple[int, list[int]]:
        """The voters that fire, one bit each, and the buckets of the text's distinct words."""
        text = text or ""
        low = text.lower()
        words = _WORD.findall(low)
        said = {w: self[w] for w in set(words)}
        hot = {w: x for w, (_, x) in said.items() if x}
        hits = [(i, hot[w]) for i, w in enumerate(words) if w in hot] if hot else []
        lists, tiers, short, long_, at = 0, [0, 0, 0, 0], 0, 0, []
        for i, (a, tier, b, c) in hits:
            lists |= a
            tiers[tier] += 1
            short, long_ = short + b, long_ + c
            if a or tier == 3:
                at.append(i)
        near = any(w in SECOND for i in at for w in words[max(i - 3, 0) : i + 4])
        most = max(Counter(words[i] for i in at).values(), default=0)
        loud = "!" in text and len(words) >= 5 and 2 * len(re.findall("[A-ZÀ-Þ]", text)) > len(text)
        fired = (tiers[3] > 0, tiers[2] > 0, tiers[1] > 1, short > 1, long_ > 1, near, most > 2, self._masked(low), loud, len(at) * 100 >= max(len(words), 1))
        mask = lists | sum(1 << (len(self.lists) + k) for k, yes in enumerate(fired) if yes)
        return mask, sorted({b for b, _ in said.values()})


def _states(voters: int, pairs: list[tuple[int, int]]) -> np.ndarray:
    """All vote patterns, and behind each its pairs that both fire."""
    bits = (np.arange(1 << voters)[:, None] >> np.arange(voters) & 1).astype(float)
    return with_pairs(bits, pairs)


def with_pairs(fired: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    return np.hstack([fired, *[fired[:, [j]] * fired[:, [k]] for j, k in pairs]])


def fit_class(mean: np.ndarray, start: np.ndarray, states: np.ndarray, ridge: float, steps: int = 30) -> tuple[np.ndarray, float]:
    """Potentials under which patterns have the given mean statistics, and the logarithm of their normaliser.

    Newton's method on the concave likelihood; a step that doesn't raise it is
    halved.
    """

    def likelihood(w: np.ndarray) -> tuple[float, np.ndarray, float]:
        score = states @ w
        top = score.max()
        p = np.exp(score - top)
        z = float(top + np.log(p.sum()))
        return float(mean @ w) - z - ridge / 2 * float(w @ w), p / p.sum(), z

    w = start
    have, p, z = likelihood(w)
    for _ in range(steps):
        now = p @ states
        slope = mean - now - ridge * w
        hess = (states * p[:, None]).T @ states - np.outer(now, now) + (ridge + 1e-6) * np.eye(len(w))
        step, share = np.linalg.solve(hess, slope), 1.0
        while share > 1e-4:
            got, q, y = likelihood(w + share * step)
            if got >= have:
                break
            share /= 2
        if share <= 1e-4:
            break
        w, gain, have, p, z = w + share * step, got - have, got, q, y
        if gain < 1e-9:
            break
    return w, z


def dependent(fired: np.ndarray, weights: tuple[np.ndarray, np.ndarray], most: int = 24, least: float = 0.1) -> list[tuple[int, int]]:
    """Pairs of voters that are correlated within a class, the strongest `most`."""
    strength: dict[tuple[int, int], float] = {}
    for w in weights:
        if w.sum() < 1:
            continue
        rate = w @ fired / w.sum()
        centred = fired - rate
        cov = (centred * w[:, None]).T @ centred / w.sum()
        dev = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        rho = np.abs(cov / dev[:, None] / dev[None, :])
        for j in range(len(rate)):
            for k in range(j + 1, len(rate)):
                if rho[j, k] >= least:
                    strength[j, k] = max(strength.get((j, k), 0.0), float(rho[j, k]))
    return sorted(sorted(strength, key=lambda e: (-strength[e], e))[:most])


def fit_label_model(fired: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 40, joint: int = 8) -> tuple[np.ndarray, dict]:
    """Generative label model over vote patterns: posterior of label 1 for each pattern, and its estimates.

    fired: patterns x voters (0 or 1); label: a person's label of the pattern's
    rows (1, 0, or -1 for none), itself a voter that may err; weight: rows.
    Within a class patterns have a potential for each voter and for each pair
    of dependent voters.  Expectation maximisation starts from independent
    voters; pairs that are then correlated within a class get potentials of
    their own, estimated with the others from exact sums over all patterns, so
    what one voter repeats of another is not counted twice.
    """
    fired = fired.astype(float)
    voters, total = fired.shape[1], max(weight.sum(), 1e-9)
    known = label >= 0
    post = np.where(known, np.clip(label, 0.02, 0.98), np.where(fired.any(1), 0.5, 0.02))
    human = np.array([0.02, 0.98])

    def prior_and_human() -> float:
        nonlocal human
        w1, w0 = weight * post, weight * (1 - post)
        if known.any():
            k1, k0 = w1 * known, w0 * known
            human = np.clip([(k0 @ (label == 1) + 0.02) / (k0.sum() + 1), (k1 @ (label == 1) + 0.98) / (k1.sum() + 1)], *ERRS)
        return float(np.clip(w1.sum() / total, 1e-3, 0.5))

    def posterior(evidence: np.ndarray, prior: float) -> np.ndarray:
        said = np.where(label == 1, np.log(human[1] / human[0]), np.where(label == 0, np.log((1 - human[1]) / (1 - human[0])), 0))
        return 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + evidence + said, -40, 40)))

    def smoothed(w: np.ndarray, x: np.ndarray, toxic: bool) -> np.ndarray:
        return (w @ x + (0.5 if toxic else 0.1)) / (w.sum() + 1)

    for _ in range(rounds):
        prior = prior_and_human()
        rate = np.stack([smoothed(weight * (1 - post), fired, False), smoothed(weight * post, fired, True)])
        rate[1] = np.maximum(rate[1], rate[0])  # a voter never speaks for the clean class by firing
        post = posterior(np.where(fired == 1, np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0]))).sum(1), prior)
    pairs = dependent(fired, (weight * (1 - post), weight * post))
    if pairs:
        states, x = _states(voters, pairs), with_pairs(fired, pairs)
        logit = lambda r: np.concatenate([np.log(r / (1 - r)), np.zeros(len(pairs))])
        w0, w1 = logit(rate[0]), logit(rate[1])
        for _ in range(joint):
            prior = prior_and_human()
            (w0, z0), (w1, z1) = (fit_class(smoothed(w, x, toxic), start, states, 1e-4) for w, start, toxic in ((weight * (1 - post), w0, False), (weight * post, w1, True)))
            post = posterior(x @ (w1 - w0) - (z1 - z0), prior)
    return post, {"prior": prior, "rates": rate, "human": human, "pairs": pairs}


def fit_classifier(rows: list[np.ndarray], dense: np.ndarray, soft: np.ndarray, ridge: float = 0.5, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression on posterior labels: weights of buckets and of the columns of dense, whose last one is constant.

    rows: the buckets of each text, which weigh one over the root of their
    number.  Gradient steps are scaled by the diagonal of the Hessian and carry
    momentum.
    """
    size = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    of, scale = np.repeat(np.arange(len(rows)), size), 1 / np.sqrt(np.maximum(size, 1))
    w, v = np.zeros(BUCKETS), np.zeros(dense.shape[1])
    mw, mv = np.zeros_like(w), np.zeros_like(v)
    few = np.full(dense.shape[1], ridge)
    few[-1] = 1e-3
    for k in range(rounds):
        score = np.bincount(of, weights=w[flat], minlength=len(rows)) * scale + dense @ v
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        off, bend = p - soft, np.maximum(p * (1 - p), 1e-3)
        gw = np.bincount(flat, weights=(off * scale)[of], minlength=BUCKETS) + 20 * ridge * w
        hw = np.bincount(flat, weights=(bend * scale**2)[of], minlength=BUCKETS) + 20 * ridge
        gv = dense.T @ off + few * v
        hv = (dense * bend[:, None]).T @ dense + np.diag(few)
        rate = 0.5 if k < rounds // 2 else 0.25
        mw, mv = 0.5 * mw - rate * gw / hw, 0.5 * mv - rate * np.linalg.solve(hv, gv)
        w, v = w + mw, v + mv
    return w, v


def _bits(mask: np.ndarray) -> np.ndarray:
    return (mask[:, None] >> np.arange(len(VOTERS)) & 1).astype(float)


def toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Toxicity of every row's whole text: doc_id, held_out, score and predicted.

    labels: doc_id and toxic; null labels are ignored, a document labelled
    several times is toxic if any label says so.  Lexicon, label model and
    classifier see only rows that are not held out.  The lexicon is learned
    from all labelled rows, the label model counts the vote patterns of all
    rows, the classifier is fitted on at most MOST_FIT rows, and every row is
    scored.  Score is the classifier's probability from a text's voters and
    hashed words, so null and empty texts get the same low score; texts of any
    length are read whole, rows that repeat are scored one by one, a score of
    exactly THRESHOLD is predicted.  Without labels the curated lexicons and
    patterns vote alone; without rows the result is empty; further columns are
    not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    known = materialize(known, "toxic-labels").withColumnRenamed("doc_id", "l_")
    same = F.col("doc_id") == F.col("l_")
    learned = learn_lexicon(join_small(rows, known, same, "inner", MOST_BROADCAST).select("text", "toxic"))
    lexicon = spark.sparkContext.broadcast(learned)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(lexicon.value)
        for b in batches:
            got = [voters.read(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m for m, _ in got], pa.int64()), pa.array([w for _, w in got], pa.list_(pa.int16()))], ["doc_id", "mask", "words"])

    seen = materialize(rows.mapInArrow(read, "doc_id bigint, mask bigint, words array<smallint>"), "toxic-votes")
    train = seen.where(~held_out(F.col("doc_id"))).join(known, same, "left").select("doc_id", "mask", F.coalesce("toxic", F.lit(-1)).alias("toxic"), "words")
    patterns = train.groupBy("mask", "toxic").agg(F.count(F.lit(1)).alias("rows")).orderBy("mask", "toxic").collect()
    table = np.array([list(p) for p in patterns], dtype=np.int64).reshape(len(patterns), 3)
    post, _ = fit_label_model(_bits(table[:, 0]), table[:, 1], table[:, 2].astype(float)) if len(table) else (np.zeros(0), {})
    soft = {(int(m), int(t)): p for (m, t, _), p in zip(table.tolist(), post.tolist(), strict=True)}

    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("mask"), F.size("words"), F.hash("words")]
    # A share of the ids by their hash leaves little to order; the bound holds whatever ids repeat.
    share = min(1.0, 1.2 * MOST_FIT / max(int(table[:, 2].sum()), 1))
    some = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40))) if share < 1 else train
    words, masks, goal = [], [], []
    for r in materialize(some.orderBy(*order).limit(MOST_FIT), "toxic-fit").orderBy(*order).toLocalIterator():
        words.append(np.array(r.words, dtype=np.int16))
        masks.append(r.mask)
        goal.append(soft[r.mask, r.toxic])
    dense = np.hstack([_bits(np.array(masks, dtype=np.int64)), np.ones((len(masks), 1))])
    weights, own = fit_classifier(words, dense, np.array(goal)) if words else (np.zeros(BUCKETS), np.append(np.full(len(VOTERS), 1.0), -4.0))

    held = F.lit([float(x) for x in weights]).cast("array<double>")
    said = F.lit(float(own[-1]))
    for k in range(len(VOTERS)):
        said = said + F.shiftright("mask", k).bitwiseAND(F.lit(1)) * float(own[k])
    size = F.sqrt(F.greatest(F.size("words"), F.lit(1)).cast("double"))
    logit = said + F.aggregate("words", F.lit(0.0), lambda a, b: a + F.get(held, b.cast("int"))) / size
    score = 1 / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-40.0)), F.lit(40.0))))
    scored = seen.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
