"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at counts of one text and votes good, bad or abstains. Per class and rule the vote probabilities
are estimated by expectation-maximisation over all documents; only how often each pattern of votes occurs is
needed (at most 3 ** rules patterns, whatever the corpus holds), so the estimation runs on the driver. A document
is kept where its posterior probability of being good is at least one half and no base rule fails.

Null and empty texts have no words: they fail the base rule of least words and aren't kept. Repeated rows get equal
results; an empty table gives an empty result; columns besides the two named aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import field_ddl, fresh, sliced, stored, without

LEAST_WORDS = 50
MOST_REPEAT_PERCENT = 50

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_PLAIN = re.compile(rb"[A-Za-z\x80-\xff'-]+[.,;:!?]?")
_SPACES = b" \t\n\x0b\x0c\r"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_ends", "n_shouts", "n_frequent", "n_plain"]


def counts_of(text: str) -> tuple[int, ...]:
    """The counts named in _COUNTS for one text."""
    raw = text.encode()
    words = raw.split()  # splits bytes at the six ASCII white-space characters only
    n = len(words)
    if not n:
        return (0, 0, len(_SYMBOLS.findall(text)), *[0] * 9)
    # Line breaks lie outside words, so lines hold the words in order.
    lines, seen, dup = 0, set(), 0
    for line in raw.split(b"\n"):
        if line.strip(_SPACES):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeats = 0
    windows = Counter(zip(words, words[1:], words[2:]))
    if n > 2 and len(windows) < n - 2:
        covered = np.zeros(n + 3, np.int32)
        at = np.fromiter((k for k, x in enumerate(zip(words, words[1:], words[2:])) if windows[x] > 1), np.int64)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + 3, -1)
        repeats = int((np.cumsum(covered) > 0).sum())
    spaces = len(raw) - len(raw.translate(None, _SPACES))
    by_word = Counter(words)
    ends = sum(c for w, c in by_word.items() if w[-1] in b".?!")
    plain = sum(c for w, c in by_word.items() if _PLAIN.fullmatch(w))
    upper = sum(map(str.isupper, text))
    letters = sum(map(str.isalpha, text))
    top = by_word.most_common(1)[0][1]
    return n, len(text) - spaces, len(_SYMBOLS.findall(text)), dup, repeats, lines, upper, letters, ends, text.count("!!"), top, plain


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, the counts of each whole text); th is the text's 64-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                found = np.array([counts_of(x or "") for x in batch.column(2).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(found[:, k]) for k in range(len(_COUNTS)))], ["id", "th", *_COUNTS])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    schema = f"id {field_ddl(docs, id_col)}, th long, " + ", ".join(f"{c} long" for c in _COUNTS)
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _vote(bad: Column, good: Column) -> Column:
    """2: bad, 1: good, 0: abstains."""
    return F.when(bad, F.lit(2)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """The votes as columns over the counts; products stand in for quotients, so that no division by zero occurs."""
    c = F.col
    words, letters, lines = c("n_words"), c("n_letters"), c("n_lines")
    return {
        "length": _vote(words < LEAST_WORDS, words >= 2 * LEAST_WORDS),
        "word_length": _vote((c("word_chars") < 2 * words) | (c("word_chars") > 12 * words), (c("word_chars") >= 3 * words) & (c("word_chars") <= 9 * words)),
        "symbols": _vote(10 * c("n_symbols") > words, 50 * c("n_symbols") < words),
        "duplicate_lines": _vote((c("n_dup_lines") >= 3) & (10 * c("n_dup_lines") > 3 * lines), c("n_dup_lines") == 0),
        "repeated_words": _vote(10 * c("n_repeat_words") > 4 * words, 10 * c("n_repeat_words") < words),
        "upper_case": _vote(10 * c("n_upper") > 4 * letters, 5 * c("n_upper") < letters),
        "sentence_ends": _vote((words >= LEAST_WORDS) & (200 * c("n_ends") < words), 50 * c("n_ends") > words),
        "shouting": _vote(20 * c("n_shouts") > words, c("n_shouts") == 0),
        "plain_words": _vote(2 * c("n_plain") < words, 10 * c("n_plain") > 9 * words),
        "one_word": _vote((words >= LEAST_WORDS) & (4 * c("n_frequent") > words), 7 * c("n_frequent") < words),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, smoothing: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns and how often each occurs.

    Returns the posterior probability of good per pattern, the class shares (bad, good) and the vote probabilities
    [class, rule, vote]. It starts from the share of good votes among the votes cast; the smoothing keeps every
    rule better than a coin at first and every probability above 0.
    """
    votes = np.array([p for p, _ in patterns], np.int64).reshape(len(patterns), -1)
    n = np.array([c for _, c in patterns], float)
    good, bad = (votes == 1).sum(1), (votes == 2).sum(1)
    post = np.where(bad == 0, 0.99, np.where(bad >= 2, 0.02, good / (good + 6.0)))
    share, table = np.array([0.5, 0.5]), np.zeros((2, votes.shape[1], 3))
    for _ in range(rounds):
        weight = np.stack([n * (1 - post), n * post])
        share = (weight.sum(1) + smoothing) / (n.sum() + 2 * smoothing)
        for v in range(3):
            table[:, :, v] = weight @ (votes == v) + smoothing
        table[0, :, 2] += smoothing  # towards rules that are right
        table[1, :, 1] += smoothing
        table /= table.sum(2, keepdims=True)
        score = np.log(share)[:, None] + sum(np.log(table[:, r, votes[:, r]]) for r in range(votes.shape[1]))
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -700, 700)))
        if np.abs(new - post).max() < 1e-9:
            post = new
            break
        post = new
    return post, share, table


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id, th, counts, votes, base_failed, p_good, kept) per document."""
    spark = docs.sparkSession
    names = list(rules())
    code = sum((vote * 3**k for k, vote in enumerate(rules().values())), F.lit(0))
    table = stored(counts(docs, id_col, text_col).withColumn("votes", code.cast("int")), "quality")
    found = table.groupBy("votes").count().collect()  # at most 3 ** rules rows
    patterns = sorted((tuple(r[0] // 3**k % 3 for k in range(len(names))), r[1], r[0]) for r in found)
    post = estimate([(p, n) for p, n, _ in patterns])[0] if patterns else []
    verdicts = spark.createDataFrame([(int(code), float(p)) for (_, _, code), p in zip(patterns, post)], "votes int, p_good double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    return (
        table.join(F.broadcast(verdicts), "votes")  # bounded like the patterns
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("p_good") >= least))
        .select(id_col, "th", *_COUNTS, "votes", "base_failed", "p_good", "kept")
    )


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of the documents that are kept, with all their columns."""
    id_, th = fresh("id", docs.columns), fresh("th", docs.columns)
    rejected = judged(docs, id_col, text_col, least).filter("not kept").select(F.col(id_col).alias(id_), F.col("th").alias(th)).distinct()
    return without(docs, stored(rejected, "rejected"), F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(th)))
