"""Line sequence labelling: a linear-chain CRF marks lines as content or boilerplate.

The chain has two states. It is fitted on all lines of at most `TRAINING_TEXTS` labelled documents:
lines of documents of good quality count as content, lines of bad documents, and in any document
lines that repeat an earlier one or are mostly symbols, as boilerplate. Spark keeps three bytes per line
and adds up the gradients. Viterbi decoding labels the lines of whole texts; a text is kept when
enough of its words stand in content lines.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brightshelf.llm.frames import TEXT, bounded, scan_text, text_buffer
from brightshelf.llm.words import NOT_SPACE, Hasher, Words, code_points, member_table, split, windows
from brightshelf.session import materialise

SYMBOLS = member_table(b"#*$%&|<>", False)
NOT_NEWLINE = member_table(b"\n", True)
DIGITS = member_table(b"0123456789", False)
STOPS = member_table(b".!?:;\"')", False)
TRAINING_TEXTS = 2000  # bound of the labelled sample; its texts are read whole
TEXTS_PER_FILE = 128  # about so many texts are in one task of a pass of the fit
CONTENT, BOILERPLATE = 0, 1
FEATURES = 12


@dataclass(frozen=True)
class Chain:
    emit: np.ndarray  # feature x 2
    move: np.ndarray  # 2 x 2, from x to


# Used where no labels exist: symbols, repeats and link-like lines speak against content.
PRIOR = Chain(
    np.array([[1.0, 0], [0, 3.0], [0, 2.5], [0, 1.0], [0, 0.3], [0, 0], [0.5, 0], [1.0, 0], [0, 0.5], [0, 2.0], [0, 0], [0, 0]]),
    np.array([[1.0, 0.0], [0.0, 1.0]]),
)


@dataclass
class Lines:
    text: np.ndarray  # number of the text of each line that has a word
    words: np.ndarray
    features: np.ndarray  # line x FEATURES, 0 or 1
    repeated: np.ndarray
    symbolic: np.ndarray


def _sums(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    running = np.r_[0, np.cumsum(flags)]
    return running[end] - running[start]


def seen_before(value: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Flags of values that stand earlier in the same text."""
    out = np.zeros(len(value), bool)
    if len(value):
        order = np.lexsort((np.arange(len(value)), value, text))
        out[order[1:]] = (value[order][1:] == value[order][:-1]) & (text[order][1:] == text[order][:-1])
    return out


def repeated_windows(hashes: np.ndarray, words: Words, size: int) -> np.ndarray:
    """Flags of words that lie in a window of `size` words found twice or more in their text."""
    covered = np.zeros(len(hashes) + 1, np.int64)
    value, text = windows(hashes, words, size)
    if not len(value):
        return covered[:-1] > 0
    order = np.lexsort((value, text))
    same = (value[order][1:] == value[order][:-1]) & (text[order][1:] == text[order][:-1])
    twice = np.zeros(len(value), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    of_word = words.text_of()
    begin = np.flatnonzero(of_word[: len(hashes) - size + 1] == of_word[size - 1 :])[twice]
    np.add.at(covered, begin, 1)
    np.add.at(covered, np.minimum(begin + size, len(hashes)), -1)
    return np.cumsum(covered[:-1]) > 0


def line_table(data: np.ndarray, offsets: np.ndarray, words: Words) -> Lines:
    lines = split(data, offsets, NOT_NEWLINE)
    line_text = lines.text_of()
    count = np.searchsorted(words.start, lines.end) - np.searchsorted(words.start, lines.start)
    has = count > 0
    begin, end, text, count = lines.start[has], lines.end[has], line_text[has], count[has]
    repeated = seen_before(Hasher(fold=False)(data, Words(begin, end, np.zeros(1, np.int64))), text)
    size = np.maximum(end - begin, 1)
    symbols = _sums(SYMBOLS[data], begin, end) / size
    digits = _sums(DIGITS[data], begin, end) / size
    last = data[np.maximum(end - 1, 0)] if len(data) else np.zeros(0, np.uint8)
    letters = size / count
    columns = [
        np.ones(len(begin)),
        symbols > 0.15,
        repeated,
        digits > 0.3,
        count < 3,
        count > 8,
        count > 20,
        STOPS[last],
        letters < 3,
        letters > 25,
        (symbols > 0) & (symbols <= 0.15),
        digits > 0.1,
    ]
    features = np.column_stack(columns).astype(np.float64) if len(begin) else np.zeros((0, FEATURES))
    return Lines(text, count, features, repeated, symbols > 0.15)


def viterbi(scores: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best labels of one chain; ties go to content."""
    n = len(scores)
    back = np.zeros((n, 2), np.int8)
    cc, cb, bc, bb = move[0, 0], move[0, 1], move[1, 0], move[1, 1]
    steps = scores.tolist()
    c, b = steps[0]
    for i in range(1, n):
        e, f = steps[i]
        cc_, bc_, cb_, bb_ = c + cc, b + bc, c + cb, b + bb
        back[i] = (bc_ > cc_, bb_ > cb_)
        c, b = e + max(cc_, bc_), f + max(cb_, bb_)
    out = np.zeros(n, np.int8)
    out[-1] = b > c
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def _gradient(flags: np.ndarray, label: np.ndarray, length: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray]:
    """Observed minus expected feature and transition counts of many labelled chains (forward-backward).

    The chains stand one after the other in `flags` and `label`. With two labels a message is one
    number, the log odds of boilerplate, and a step is taken by all chains that are long enough at once.
    """
    x = (flags[:, None].astype(np.int64) >> np.arange(FEATURES)) & 1
    odds = x @ (chain.emit[:, BOILERPLATE] - chain.emit[:, CONTENT])
    order = np.argsort(-length, kind="stable")
    start = (np.cumsum(length) - length)[order]
    active = len(length) - np.searchsorted(np.sort(length), np.arange(1, length.max() + 1))
    forward, backward = odds.copy(), np.zeros(len(odds))
    move = np.exp(chain.move)
    for i in range(1, len(active)):
        at = start[: active[i]] + i
        b = np.exp(forward[at - 1])
        forward[at] += np.log((move[0, 1] + b * move[1, 1]) / (move[0, 0] + b * move[1, 0]))
    for i in range(len(active) - 1, 0, -1):
        at = start[: active[i]] + i
        b = np.exp(odds[at] + backward[at])
        backward[at - 1] = np.log((move[1, 0] + b * move[1, 1]) / (move[0, 0] + b * move[0, 1]))
    miss = label - 1 / (1 + np.exp(-forward - backward))
    inner = np.ones(len(odds), bool)
    inner[start] = False
    to = np.flatnonzero(inner)
    b, e = np.exp(forward[to - 1]), np.exp(odds[to] + backward[to])
    joint = np.stack([np.full(len(to), move[0, 0]), e * move[0, 1], b * move[1, 0], b * e * move[1, 1]])
    seen = np.bincount(2 * label[to - 1].astype(np.int64) + label[to], minlength=4)
    emit = x.T @ miss
    return np.column_stack([-emit, emit]), (seen - (joint / joint.sum(axis=0)).sum(axis=1)).reshape(2, 2)


def labelled_chains(texts: DataFrame, text: str = "text", fine: str = "fine") -> DataFrame:
    """(flags, label): per text with lines, two bytes of flags and one of the label for each of its lines."""
    source = texts.select(F.col(text).cast("string").cast("binary").alias(TEXT), F.col(fine).alias("fine"))

    def run(batches):
        for batch in batches:
            for part in bounded(batch):
                data, offsets = text_buffer(part)
                lines = line_table(data, offsets, split(data, offsets, NOT_SPACE))
                good = part.column("fine").to_numpy(zero_copy_only=False).astype(bool)
                label = (lines.repeated | lines.symbolic | ~good[lines.text]).astype(np.uint8)
                flags = (lines.features.astype(np.int64) @ (1 << np.arange(FEATURES))).astype(np.uint16)
                first = np.searchsorted(lines.text, np.arange(part.num_rows + 1))
                used = [(a, b) for a, b in zip(first, first[1:]) if a < b]
                columns = [pa.array([v[a:b].tobytes() for a, b in used], pa.binary()) for v in (flags, label)]
                yield pa.RecordBatch.from_arrays(columns, names=["flags", "label"])

    return source.mapInArrow(run, "flags binary, label binary")


def _step(chains: DataFrame, chain: Chain) -> tuple[int, np.ndarray, np.ndarray]:
    """Lines of all chains and the sum of their gradients; a task hands on one row of 29 numbers per Arrow batch."""

    def run(batches):
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("flags", "label")]
            if columns[0]:
                flags, label = np.frombuffer(b"".join(columns[0]), np.uint16), np.frombuffer(b"".join(columns[1]), np.uint8)
                emit, move = _gradient(flags, label, np.array([len(c) for c in columns[1]]), chain)
                total = np.r_[len(label), emit.ravel(), move.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    total = np.sum([np.zeros(2 * FEATURES + 5), *(r.sums for r in chains.mapInArrow(run, "sums array<double>").collect())], axis=0)
    return int(total[0]), total[1:-4].reshape(FEATURES, 2), total[-4:].reshape(2, 2)


def fit_chain(chains: DataFrame, rounds: int = 30, rate: float = 1.0, pull: float = 0.02) -> Chain:
    """Fit by gradient ascent, pulled to the prior chain; without chains the prior itself.

    Each round is one pass of Spark over `chains`; the driver holds 28 weights.
    """
    chain = PRIOR
    for _ in range(rounds):
        total, emit, move = _step(chains, chain)
        if not total:
            break
        emit, move = emit / total - pull * (chain.emit - PRIOR.emit), move / total - pull * (chain.move - PRIOR.move)
        chain = Chain(chain.emit + rate * emit, chain.move + rate * move)
    return chain


def train(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", bound: int = TRAINING_TEXTS) -> Chain:
    """Chain fitted on the documents of at most `bound` labelled ids, those with the smallest hashes.

    The texts are read whole. Of several labels of an id the smallest counts; every row of a repeated
    id is read; rows without an id, text or label teach nothing; without labelled lines the prior chain is returned.
    """
    chosen = labels.where(F.col(quality).isNotNull()).groupBy(doc_id).agg((F.min(quality) == 1).alias("fine")).orderBy(F.xxhash64(doc_id), doc_id).limit(bound)
    texts = documents.select(doc_id, F.col(text).alias(TEXT)).join(F.broadcast(chosen), doc_id)
    chains = labelled_chains(texts, TEXT)
    # Few bytes a line, so a pass of the fit is one short task per TEXTS_PER_FILE texts.
    chains = chains.repartition(math.ceil(bound / TEXTS_PER_FILE))
    return fit_chain(materialise(chains, "labelled-chains"))


def _kernel(chain: Chain, content_share: float):
    def run(batch: pa.RecordBatch) -> dict:
        data, offsets = text_buffer(batch)
        n = len(offsets) - 1
        words = split(data, offsets, NOT_SPACE)
        of_word = words.text_of()
        points = code_points(data)
        n_words = words.counts()
        lines = line_table(data, offsets, words)
        again = repeated_windows(Hasher(fold=False)(data, words), words, 3)
        scores = lines.features @ chain.emit
        first = np.searchsorted(lines.text, np.arange(n + 1))
        content = np.zeros(n, np.int64)
        for i in np.flatnonzero(np.diff(first)):
            a, b = first[i], first[i + 1]
            content[i] = lines.words[a:b][viterbi(scores[a:b], chain.move) == CONTENT].sum()
        n_repeat = np.bincount(of_word, again, n).astype(np.int64)
        failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
        share = content / np.maximum(n_words, 1)
        return {
            "n_words": n_words,
            "word_chars": np.bincount(of_word, points[words.end] - points[words.start], n).astype(np.int64),
            "n_symbols": _sums(SYMBOLS[data], offsets[:-1], offsets[1:]),
            "n_dup_lines": np.bincount(lines.text, lines.repeated, n).astype(np.int64),
            "n_repeat_words": n_repeat,
            "base_failed": failed,
            "kept": ~failed & (share >= content_share),
            "content_share": share,
        }

    return run


def judge(df: DataFrame, keep: list[str], chain: Chain, text: str = "text", content_share: float = 0.4) -> DataFrame:
    """One row per row of `df`: `keep`, the counts, base_failed, kept and content_share.

    Null and empty texts have zero words, fail the base rules and are not kept. Repeated rows give
    repeated results; columns outside `keep` are not read.
    """
    ddl = (
        "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "base_failed boolean, kept boolean, content_share double"
    )
    return scan_text(df, keep, text, _kernel(chain, content_share), ddl)
