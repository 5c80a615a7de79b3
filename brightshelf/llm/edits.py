"""Edit-aware token counts: pre-token segment trees that edits update in place.

A text is cut into pre-tokens by the tokenizer's pattern, and byte-pair codes never cross one. A leaf
of a document's segment tree is a run of `LEAF` pre-tokens with its characters and tokens; an inner
node has the sums of its two children. An edit finds its leaves by descending the character sums,
splits and encodes only those leaves and the context at their borders again, and adds the difference
along their paths to the root.

Two facts keep this exact. The pattern never looks back, so a split that starts at a pre-token's
border equals the split of the whole text from there on. It looks at most two characters past the end
of a match, so matches that end `CONTEXT` characters before an edit stay as they are.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from brightshelf.llm.frames import TEXT, scan_text
from brightshelf.llm.words import member_table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 16  # pre-tokens of a leaf where pre-tokens are counted out
LEAF_BYTES = 256  # about the size of a leaf where words stand between single blanks
UNCUT = 1024  # characters of a run without such a blank from which on pre-tokens are counted out
CROWDED = 64  # pre-tokens of a leaf after which the leaves are laid out anew
CONTEXT = 3  # characters past its end on which a pre-token may depend
REMEMBERED = 1 << 18  # pre-tokens whose counts a worker keeps; others are encoded again

EDIT = "struct<at:bigint,removed:bigint,inserted:string>"
TREE = "tree_chars array<bigint>, tree_tokens array<bigint>"


class Tokens:
    """Pre-tokens of a text and the number of tokens of each."""

    def __init__(self, vocabulary: str, pattern: str):
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        encoder = tiktoken.Encoding("pre-tokens", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = lambda text: len(encoder.encode_ordinary(text))
        self.count = lru_cache(REMEMBERED)(self.whole)
        self.pattern = regex.compile(pattern)


@lru_cache(4)
def tokens_of(vocabulary: str, pattern: str) -> Tokens:
    """One per worker process: the vocabulary is read once, not once per batch."""
    return Tokens(vocabulary, pattern)


def _tree(leaves: np.ndarray) -> np.ndarray:
    """Sums in heap order: node i has the children 2i and 2i + 1, leaves begin at half the length."""
    size = 1 << max(0, int(len(leaves) - 1).bit_length())
    out = np.zeros(2 * size, np.int64)
    out[size : size + len(leaves)] = leaves
    level = size
    while level > 1:
        out[level // 2 : level] = out[level : 2 * level].reshape(-1, 2).sum(axis=1)
        level //= 2
    return out


VISIBLE = member_table(bytes(range(0x21, 0x7F)), False)
LETTERS = member_table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", False)


def _runs(text: str) -> list[str]:
    """The text cut before single blanks between a visible ASCII character and an ASCII letter.

    Under `PATTERN` such a blank always begins a pre-token, and what stands before it is split the
    same way without it, so a run is encoded as in the whole text.
    """
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data) < 2 * LEAF_BYTES:
        return [text]
    at = 1 + np.flatnonzero((data[1:-1] == 0x20) & VISIBLE[data[:-2]] & LETTERS[data[2:]])
    block = at // LEAF_BYTES
    at = at[np.diff(block, prepend=0) > 0]
    if len(data) > len(text):
        at = np.cumsum((data & 0xC0) != 0x80)[at - 1]
    cuts = [0, *at.tolist(), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def build_tree(text: str, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Character and token sums of a whole text."""
    chars: list[int] = []
    sums: list[int] = []
    for run in _runs(text) if tokens.pattern.pattern == PATTERN else [text]:
        if len(run) < UNCUT and tokens.pattern.pattern == PATTERN:
            chars.append(len(run))
            sums.append(tokens.whole(run))
            continue
        pieces = tokens.pattern.findall(run)
        for i in range(0, len(pieces), LEAF):
            chars.append(sum(map(len, pieces[i : i + LEAF])))
            sums.append(sum(map(tokens.count, pieces[i : i + LEAF])))
    return _tree(np.array(chars or [0], np.int64)), _tree(np.array(sums or [0], np.int64))


class Counted:
    """One text with its tree, open for edits."""

    def __init__(self, text: str, chars: np.ndarray, sums: np.ndarray, tokens: Tokens):
        self.tokens, self.encoded = tokens, 0
        self.chars, self.sums = chars.copy(), sums.copy()
        ends = np.cumsum(self.chars[len(self.chars) // 2 :]).tolist()
        self.parts = [text[a:b] for a, b in zip([0, *ends], ends)]

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1])

    def text(self) -> str:
        return "".join(self.parts)

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at` (the last filled one for the end), and where it begins."""
        node, skipped, size = 1, 0, len(self.parts)
        at = min(at, max(0, int(self.chars[1]) - 1))
        while node < size:
            node *= 2
            left = int(self.chars[node])
            if at - skipped >= left:
                skipped += left
                node += 1
        return node - size, skipped

    def _put(self, leaf: int, text: str, n_tokens: int) -> None:
        node = leaf + len(self.parts)
        chars, sums = len(text) - int(self.chars[node]), n_tokens - int(self.sums[node])
        self.parts[leaf] = text
        while node and (chars or sums):
            self.chars[node] += chars
            self.sums[node] += sums
            node //= 2

    def _lay_out(self, leaf: int, pieces: list[str]) -> None:
        """Give the pre-tokens of a crowded leaf leaves of their own; no other leaf is encoded."""
        fresh = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)]
        old = self.sums[len(self.parts) :]
        used = np.array([bool(p) for p in self.parts])
        used[leaf] = False
        before, after = np.flatnonzero(used[:leaf]), leaf + np.flatnonzero(used[leaf:])
        counts = np.r_[old[before], [sum(map(self.tokens.count, f)) for f in fresh], old[after]].astype(np.int64)
        parts = [*(self.parts[i] for i in before), *map("".join, fresh), *(self.parts[i] for i in after)]
        self.chars, self.sums = _tree(np.array([len(p) for p in parts])), _tree(counts)
        self.parts = parts + [""] * (len(self.chars) // 2 - len(parts))

    def edit(self, at: int, removed: int, inserted: str) -> None:
        """Put `inserted` in place of `removed` characters from `at`; both are cut to the text."""
        length = int(self.chars[1])
        at = min(max(0, at), length)
        to = min(length, at + max(0, removed))
        if at == to and not inserted:
            return
        first, start = self._leaf(max(0, at - CONTEXT))
        last, end = first, start
        region = []
        while last < len(self.parts) and (end < to or last == first):
            region.append(self.parts[last])
            end += len(self.parts[last])
            last += 1
        old = "".join(region)
        buffer = old[: at - start] + inserted + old[to - start :]
        border = ahead = len(buffer)  # where the touched leaves end; text behind it is only looked at
        read = last
        pieces: list[str] = []
        place = 0
        while place != border:
            while ahead == len(buffer) and read < len(self.parts):
                buffer += self.parts[read]
                read += 1
            match = self.tokens.pattern.match(buffer, place)
            if match.end() + CONTEXT > len(buffer) and read < len(self.parts):
                # Too close to the end of what was read: read at least as much again.
                wanted, more = len(buffer) - place + CONTEXT, []
                while read < len(self.parts) and wanted > 0:
                    more.append(self.parts[read])
                    wanted -= len(more[-1])
                    read += 1
                buffer += "".join(more)
                continue
            pieces.append(match.group())
            place = match.end()
            while border < place:
                border += len(self.parts[last])
                last += 1
        counts = list(map(self.tokens.count, pieces))
        self.encoded += border
        for leaf in range(first + 1, last):
            self._put(leaf, "", 0)
        self._put(first, buffer[:border], sum(counts))
        if len(pieces) > CROWDED:
            self._lay_out(first, pieces)


def _lists(values: list[np.ndarray]) -> pa.Array:
    first = np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(first), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))


def _texts(batch: pa.RecordBatch) -> Iterable[str | None]:
    for text in batch.column(TEXT):
        raw = text.as_py()
        yield None if raw is None else raw.decode("utf-8", "replace")


def build_trees(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """`keep`, tree_chars, tree_tokens and n_tokens of each row's whole text.

    Node 1 of a tree has the sums of the whole text; a tree takes two numbers per `LEAF` pre-tokens and
    array. Null and empty texts have a tree of one empty leaf. Repeated rows give repeated trees.
    To keep the text beside its tree, name it in `keep`.
    """

    def kernel(batch: pa.RecordBatch) -> dict:
        tokens = tokens_of(vocabulary, pattern)
        trees = [build_tree(t or "", tokens) for t in _texts(batch)]
        return {"tree_chars": _lists([t[0] for t in trees]), "tree_tokens": _lists([t[1] for t in trees]), "n_tokens": [int(t[1][1]) for t in trees]}

    return scan_text(df, keep, text, kernel, f"{TREE}, n_tokens bigint")


def _matches(text: str, searches: list[Callable], inserted: list[str]) -> list[dict]:
    found, place = [], 0
    ahead = [(s(text), i) for i, s in enumerate(searches)]
    while ahead := [(m, i) for m, i in ahead if m]:
        match, rule = min(ahead, key=lambda a: (a[0].start(), a[1]))
        if match.end() > match.start():
            found.append({"at": match.start(), "removed": match.end() - match.start(), "inserted": inserted[rule]})
        place = max(match.end(), match.start() + 1)
        ahead = [(m if m.start() >= place else searches[i](text, place), i) for m, i in ahead]
    return found


def find_edits(df: DataFrame, keep: list[str], rules: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """`keep` and `edits`: for each match of a rule's regex, its replacement, from the last match to the first.

    Matches of all rules are leftmost and do not overlap; where two begin together the earlier rule
    wins; empty matches are left out. In this order a place in the text is right when its turn comes. Null texts have no edits.
    """

    def kernel(batch: pa.RecordBatch) -> dict:
        # Each regex searches alone: one alternation of all would lose their literal prefixes.
        searches = [regex.compile(p).search for p, _ in rules]
        return {"edits": [_matches(t or "", searches, [new for _, new in rules])[::-1] for t in _texts(batch)]}

    return scan_text(df, keep, text, kernel, f"edits array<{EDIT}>")


def apply_edits(
    df: DataFrame, keep: list[str], text: str = "text", edits: str = "edits", vocabulary: str = VOCABULARY, pattern: str = PATTERN, with_text: bool = True
) -> DataFrame:
    """`keep`, the edited text (unless `with_text` is false), its tree, its n_tokens, and what it cost.

    `df` has a text, its tree (tree_chars, tree_tokens) and a list of edits (at, removed, inserted;
    characters from 0). Edits work one after the other, each on the text the earlier ones left. Places
    outside the text are moved to its nearest end; a null edit or place is skipped, a null `removed`
    is 0, a null `inserted` empty. A null text counts as empty and stays null without edits. A tree
    that does not fit its text raises. Outputs: edited_text, edited_chars, edited_tokens, n_edits
    (skipped ones not counted), n_tokens_edited, chars_encoded (in regions that were encoded again).
    """
    source = df.select(*keep, df[text], df["tree_chars"].alias("_chars"), df["tree_tokens"].alias("_sums"), df[edits].alias("_edits"))

    def kernel(batch: pa.RecordBatch) -> dict:
        tokens = tokens_of(vocabulary, pattern)
        out: dict[str, list] = {n: [] for n in ("edited_text", "n_edits", "n_tokens_edited", "chars_encoded")}
        chars, sums = [], []
        for t, c, s, todo in zip(_texts(batch), batch.column("_chars"), batch.column("_sums"), batch.column("_edits")):
            c, s = c.values.to_numpy(), s.values.to_numpy()
            if int(c[1]) != len(t or ""):
                raise ValueError(f"a tree of {int(c[1])} characters lies beside a text of {len(t or '')}")
            done = [e for e in todo.as_py() or [] if e is not None and e["at"] is not None]
            if not done:
                chars.append(c), sums.append(s)
                row = (t, 0, int(s[1]), 0)
            else:
                now = Counted(t or "", c, s, tokens)
                for e in done:
                    now.edit(e["at"], e["removed"] or 0, e["inserted"] or "")
                chars.append(now.chars), sums.append(now.sums)
                row = (now.text(), len(done), now.n_tokens, now.encoded)
            for name, value in zip(out, row):
                out[name].append(value)
        if not with_text:
            del out["edited_text"]
        return out | {"edited_chars": _lists(chars), "edited_tokens": _lists(sums)}

    ddl = ("edited_text string, " if with_text else "") + "edited_chars array<bigint>, edited_tokens array<bigint>, n_edits bigint, n_tokens_edited bigint, chars_encoded bigint"
    found = scan_text(source, [*keep, "_chars", "_sums", "_edits"], text, kernel, ddl)
    return found.drop("_chars", "_sums", "_edits")
