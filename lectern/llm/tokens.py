"""Token counts by a count-only Viterbi search over a unigram vocabulary."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Fixed values of the tokenizer: the mark of a word's start, and what an unknown character costs below the least score.
MARK, PENALTY = "▁", 10.0
#: Words whose counts a worker remembers; it forgets all beyond that.
REMEMBERED = 400_000
#: Pieces that are broadcast at most; a larger vocabulary is joined instead.
MOST_PIECES = 500_000


def best_path(word: str, found: Iterable[tuple[int, int, float]], single: set[str], unknown: float, bytes_: bool) -> tuple[int, float]:
    """(pieces, score) of a word's best segmentation.

    found: (end, size, score) of all pieces in the word, by end and then from
    long to short; single: characters that are pieces.
    """
    n = len(word)
    score: list[float | None] = [0.0] + [None] * n
    count, run = [0] * (n + 1), [False] * (n + 1)  # run: the last piece is unknown
    done = 0

    def unknown_up_to(end: int) -> None:
        nonlocal done
        while done < end:  # the only way over a character that is no piece
            c = word[done]
            if c not in single and score[done] is not None:
                s = score[done] + unknown
                if score[done + 1] is None or s > score[done + 1]:
                    score[done + 1] = s
                    count[done + 1] = count[done] + (len(c.encode("utf-8", "surrogatepass")) if bytes_ else 0 if run[done] else 1)
                    run[done + 1] = True
            done += 1

    for end, size, s in found:
        start = end - size
        unknown_up_to(end - 1)
        if score[start] is None:
            continue
        s += score[start]  # noqa: PLW2901
        if score[end] is None or s > score[end]:
            score[end], count[end], run[end] = s, count[start] + 1, False
    unknown_up_to(n)
    return count[n], score[n]


class Counter(dict):
    """Counts and scores by word.

    The tokenizer is a unigram model over pieces that start words with MARK:
    blanks (U+0020) become MARK, a text gets one in front unless it has it, and
    each MARK starts a new word.  A word's segmentation has the best sum of
    scores.  Ties go to the candidate found first: at each end the one with the
    longest last piece, an unknown character last.  Unknown characters count
    as many pieces as they have UTF-8 bytes if `bytes_` holds, else one for
    each run.  Only scores and counts are kept, never a path.
    """

    def __init__(self, pieces: list[tuple[str, float]], bytes_: bool = True):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - PENALTY
        self.bytes = bytes_

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = self.search(MARK + word)
        return found

    def search(self, word: str) -> tuple[int, float]:
        """(pieces, score) of one word by dynamic programming over the automaton's matches."""
        found = ((last + 1, size, s) for last, (size, s) in self.automaton.iter(word))
        return best_path(word, found, self.single, self.unknown, self.bytes)

    def text(self, text: str | None) -> tuple[int, float]:
        """(pieces, score) of a text; a null or empty one has none."""
        if not text:
            return 0, 0.0
        text = text.replace(" ", MARK)
        found = [self[w] for w in (text if text[0] == MARK else MARK + text).split(MARK)[1:]]
        return sum(c for c, _ in found), sum(s for _, s in found)


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def token_counts(
    docs: DataFrame, pieces: list[tuple[str, float]] | DataFrame, *, doc_id: str = "doc_id", text: str = "text", bytes_: bool = True
) -> DataFrame:
    """doc_id, n_tokens and score of every row's whole text under the vocabulary.

    A vocabulary of at most MOST_PIECES pieces is broadcast; a larger one, or
    one given as a table (piece, score), meets the corpus's distinct words in
    a join.  A null or empty text has no tokens, texts of any length are read
    whole; rows that repeat are counted one by one; without rows the result is
    empty; further columns are not read.
    """
    if isinstance(pieces, DataFrame) or len(pieces) > MOST_PIECES:
        table = pieces if isinstance(pieces, DataFrame) else docs.sparkSession.createDataFrame(pieces, "piece string, score double")
        return joined_counts(docs, table, doc_id, text, bytes_)
    held = docs.sparkSession.sparkContext.broadcast(pieces)

    @F.pandas_udf("struct<n_tokens:bigint,score:double>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = Counter(held.value, bytes_)
        for texts in batches:
            yield pd.DataFrame([counter.text(t) for t in texts], columns=["n_tokens", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), count(F.col(text)).alias("c")).select("doc_id", "c.n_tokens", "c.score")


def joined_counts(docs: DataFrame, pieces: DataFrame, doc_id: str, text: str, bytes_: bool) -> DataFrame:
    """token_counts for a vocabulary of any size.

    Every distinct word of the corpus asks for its substrings of up to the
    longest piece's length, once; the pieces among them come back to the word,
    whose best path then gives its count.
    """
    pieces = pieces.where("piece <> ''").dropDuplicates(["piece"])
    facts = pieces.agg(F.min("score").alias("least"), F.max(F.length("piece")).alias("longest")).first()
    unknown, longest = (facts.least or 0.0) - PENALTY, facts.longest or 0
    marked = F.replace(F.col(text), F.lit(" "), F.lit(MARK))
    whole = F.when(F.startswith(marked, F.lit(MARK)), marked).otherwise(F.concat(F.lit(MARK), marked))
    parts = F.when(F.length(text) > 0, F.slice(F.split(whole, MARK), F.lit(2), F.size(F.split(whole, MARK))))
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), parts.alias("w")), "token-words")
    used = rows.select("rid", F.explode("w").alias("w")).groupBy("rid", "w").agg(F.count(F.lit(1)).alias("n"))
    # Words have numbers, since a long word must not be copied to each of its substrings.
    words = materialize(used.select("w").distinct().select(F.monotonically_increasing_id().alias("wid"), "w"), "distinct-words")
    word = F.concat(F.lit(MARK), F.col("w"))
    starts, sizes = F.sequence(F.lit(0), F.length(word) - 1), F.sequence(F.lit(1), F.greatest(F.least(F.lit(longest), F.length(word)), F.lit(1)))
    parts = F.flatten(F.transform(starts, lambda a: F.transform(F.filter(sizes, lambda k: a + k <= F.length(word)), lambda k: F.struct((a + k).alias("end"), k.alias("size"), F.substring(word, a + 1, k).alias("piece")))))
    asked = words.select("wid", parts.alias("parts")).select("wid", F.explode("parts").alias("p")).select("wid", "p.*")
    hits = asked.join(pieces, "piece").groupBy("wid").agg(F.array_sort(F.collect_list(F.struct("end", (-F.col("size")).alias("less"), "score"))).alias("found"))

    @F.pandas_udf("struct<c:bigint,s:double>")
    def path(words: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for w, f in zip(words, found, strict=True):
            matches = [] if f is None else [(int(m["end"]), -int(m["less"]), float(m["score"])) for m in f]
            marked = MARK + w
            out.append(best_path(marked, matches, {marked[e - 1] for e, k, _ in matches if k == 1}, unknown, bytes_))
        return pd.DataFrame(out, columns=["c", "s"])

    counted = words.join(hits, "wid", "left").select("w", path("w", "found").alias("b")).select("w", "b.*")
    sums = used.join(materialize(counted, "token-counts"), "w").groupBy("rid").agg(F.sum(F.col("n") * F.col("c")).alias("n_tokens"), F.sum(F.col("n") * F.col("s")).alias("score"))
    return rows.select("rid", "doc_id").join(sums, "rid", "left").select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("score", F.lit(0.0)).alias("score"))
