"""Operator 7, token counts: prefix dynamic programming over a sentencepiece BPE vocabulary.

The encoding of a text falls into segments that no merge crosses: a segment
begins at each run of word marks (no piece has a mark after another
character). Inside a segment the program walks over prefixes. For each prefix it finds its
last token: the one piece that ends there and may follow the last token of the
shorter prefix. The count of a prefix is that shorter prefix's count plus one,
so one pass gives the exact count at every prefix. Two tokens may follow each other if
the merges would not have joined anything across their border: while a token is being
put together, its end towards the border passes through the right parts (left
parts) of its merges, and no two such ends that exist at the same time may form a
piece that ranks before the merges that are next to take them.

``Prefixes`` keeps the counts of a text, so budgets and truncations are answered by
lookups. Runs of two or more marks merge last (they rank after all other pieces); they are
counted apart, and the walk says whether the word's first token is its mark alone, which then joins the run.

Distinct segments of a block are worked on together, in numpy, by length.
Memory is bounded by the block of documents and by the segment memory.

Defined cases: null text counts like empty text, 0 bytes and 0 tokens; repeated rows give a
row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from trackwise.llm.byte_bpe import PairTable, blocks
from trackwise.llm.common import ship_code
from trackwise.llm.langid import PieceIndex, by_length

LIMIT = 4096
MARK = "▁"
NEVER = 2**30
#: Bytes of text whose new segments are worked on together: few large numpy calls instead of many small ones.
BLOCK_BYTES = 4 << 20
MEMO_SEGMENTS = 400_000
_SEGMENT = re.compile(r" *[^ ]+| +")


class PieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
        # merges are made by score, the best first; ranks here follow that order, so equal scores have equal ranks
        scores = sorted({sp.get_score(i) for i in plain}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        self.pieces = {sp.id_to_piece(i): place[sp.get_score(i)] for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece has a word mark after another character")
        # single characters are there from the start
        self.rank = {p: (-1 if len(p) == 1 else r) for p, r in self.pieces.items()}
        inner = [p for p in self.pieces if not p.startswith(MARK * 2)]
        self.names = inner
        self.index = PieceIndex(inner)
        self.other = self.index.other  # a character that no piece has
        self.ids = {p: i for i, p in enumerate(inner)}
        self._trees(inner)
        bits = 1 << 21
        self.memo_keys, self.memo_ok = np.full(bits, -1, np.int64), np.zeros(bits, bool)
        self.known: dict[str, int] = {}
        self.spaces: dict[int, int] = {}

    # ---- how tokens are put together -----------------------------------
    def merges(self, text: str) -> tuple[list[str], dict[tuple[int, int], tuple[int, int]]]:
        """The plain algorithm on one string: its tokens, and for each span that was made, its cut and rank."""
        n, made = len(text), {}
        end, before, dead = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n + 1)
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := self.rank.get(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, mid, stop = heapq.heappop(heap)
            if dead[i] or end[i] != mid or mid >= n or dead[mid] or end[mid] != stop:
                continue
            dead[mid], end[i], made[i, stop] = 1, stop, (mid, r)
            if stop < n:
                before[stop] = i
                if (r := self.rank.get(text[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if (b := before[i]) >= 0 and (r := self.rank.get(text[b:stop])) is not None:
                heapq.heappush(heap, (r, b, i, stop))
        out, at = [], 0
        while at < n:
            out.append(text[at : end[at]])
            at = end[at]
        return out, made

    def _trees(self, pieces: list[str]) -> None:
        """For each piece its parts at the right end (left end), from the whole piece inwards, with the rank of
        the merge that takes each part; pieces that the merges never make are left out of the index."""
        size, depth = len(pieces) + 1, 0
        right, left = [], []
        self.whole = np.zeros(size + 1, bool)
        for p in pieces:
            tokens, made = self.merges(p)
            self.whole[self.ids[p]] = len(tokens) == 1
            spans = []
            for side in (0, 1):
                chain, a, b, taken = [], 0, len(p), NEVER
                while len(tokens) == 1:
                    chain.append((self.ids[p[a:b]], taken))
                    if (a, b) not in made:
                        break
                    mid, taken = made[a, b]
                    a, b = (mid, b) if side == 0 else (a, mid)
                spans.append(chain)
            right.append(spans[0]), left.append(spans[1])
            depth = max(depth, len(spans[0]), len(spans[1]))
        self.depth = depth
        self.right = np.full((size + 1, depth, 2), -1, np.int32)
        self.left = np.full((size + 1, depth, 2), -1, np.int32)
        for table, chains in ((self.right, right), (self.left, left)):
            for i, chain in enumerate(chains):
                table[i, : len(chain)] = chain
        born = np.array([self.rank[p] for p in pieces] + [-1, -1], np.int32)
        self.born = born
        pairs, ranks = [], []
        for p in pieces:
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b), ranks.append(self.rank[p])
        self.joined = PairTable(np.array(pairs, np.uint64), np.array(ranks, np.int32))

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave token ``a`` and the token ``b`` after it apart."""
        code = a.astype(np.int64) * (self.other + 2) + b
        slot = (code * 0x9E3779B1) & (len(self.memo_keys) - 1)
        known, out = self.memo_keys[slot] == code, self.memo_ok[slot]
        if not known.all():
            todo, first = np.unique(code[~known], return_index=True)
            ok = self._apart(a[~known][first], b[~known][first])
            at = (todo * 0x9E3779B1) & (len(self.memo_keys) - 1)
            self.memo_keys[at], self.memo_ok[at] = todo, ok  # of two codes in a slot the later one stays
            out[~known] = ok[np.searchsorted(todo, code[~known])]
        return out

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """All pairs of a right part of ``a`` and a left part of ``b`` that exist at one time are tried."""
        ok = np.ones(len(a), bool)
        for i in range(self.depth):
            x, x_taken = self.right[a, i, 0], self.right[a, i, 1]
            for j in range(self.depth):
                y, y_taken = self.left[b, j, 0], self.left[b, j, 1]
                both = ok & (x >= 0) & (y >= 0)
                if not both.any():
                    break
                rank = self.joined.get(np.maximum(x, 0), np.maximum(y, 0)).astype(np.int64)
                rank[~both] = NEVER
                since = np.maximum(self.born[x], self.born[y])
                # the pair merges if it ranks before what takes its right part, and not after what takes its left
                # part: of equal ranks the leftmost goes first, and the left part's own merge lies further left
                joins = (rank < NEVER) & (np.maximum(rank, since) < np.minimum(x_taken, np.int64(y_taken) + 1))
                joins &= (rank < x_taken) & (rank <= y_taken)
                ok &= ~joins
        return ok

    # ---- counts ---------------------------------------------------------
    def prefix_counts(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts at every prefix (columns 0 to length) of equally long segments without runs of marks, and whether the
        prefix's first token is one character alone."""
        n, length = points.shape
        widths = list(range(1, min(length, self.index.longest) + 1))
        cells = []
        for w, h in zip(widths, PieceIndex.rolled(points, widths), strict=True):
            ids = self.index.find(h)
            if w == 1:
                missing = ids < 0
                if missing.any():
                    ids = np.where(missing, self.other, ids)
            else:
                ids = np.where(self.whole[ids] & (ids >= 0), ids, -1)
            if w == 1 or (ids >= 0).any():
                cells.append((w, ids))
        size = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
        counts = np.zeros((n, length + 1), np.int32)
        last = np.full((n, length + 1), -1, np.int32)
        lone = np.zeros((n, length + 1), bool)
        for i in range(1, length + 1):
            open_ = np.ones(n, bool)
            for w, ids in reversed(cells):
                if w > i:
                    continue
                token = ids[:, i - w]
                rows = np.flatnonzero(open_ & (token >= 0))
                if not len(rows):
                    continue
                t, before = token[rows], last[rows, i - w]
                if i > w:
                    fits = (before == self.other) | (t == self.other)
                    ask = np.flatnonzero(~fits)
                    fits[ask] = self.may_follow(before[ask], t[ask])
                    rows, t = rows[fits], t[fits]
                last[rows, i] = t
                add = np.where(t == self.other, size[rows, i - 1], 1)  # bytes stand for a character without a piece
                counts[rows, i] = counts[rows, i - w] + add
                lone[rows, i] = lone[rows, i - w] if i > w else w == 1
                open_[rows] = False
        return counts, lone

    def run_count(self, n: int) -> int:
        """Tokens of a run of marks that nothing follows."""
        if n not in self.spaces:
            self.spaces[n] = len(self.merges(MARK * n)[0])
        return self.spaces[n]

    def segments(self, words: list[str]) -> list[int]:
        out = np.zeros(len(words), np.int64)
        plain, at, runs = [], [], []
        for k, s in enumerate(words):
            marks = len(s) - len(s.lstrip(MARK))
            if marks == len(s):
                out[k] = self.run_count(marks)
            else:
                plain.append(s[max(0, marks - 1) :]), at.append(k), runs.append(marks)
        at, runs = np.array(at, np.int64), np.array(runs, np.int64)
        for rows, points in by_length(plain):
            counts, lone = self.walked(points)
            out[at[rows]] = self.behind_run(runs[rows], counts[:, -1], lone[:, -1])
        return out.tolist()

    def walked(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._long(points) if points.shape[1] > 512 else self.prefix_counts(points)

    def behind_run(self, marks: np.ndarray, counts: np.ndarray, lone: np.ndarray) -> np.ndarray:
        """Counts with the further marks before a segment: if its first token is the mark alone, that joins the run."""
        more = np.flatnonzero(marks > 1)
        if not len(more):
            return counts
        out = counts.astype(np.int64)
        joined = marks[more] - ~lone[more]
        runs, which = np.unique(joined, return_inverse=True)
        out[more] += np.array([self.run_count(m) for m in runs.tolist()], np.int64)[which] - lone[more]
        return out

    def _long(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of any length: the same walk in pieces of columns, so that the lattice stays small."""
        step, reach = 256, self.index.longest
        n, length = points.shape
        counts, last = np.zeros((n, length + 1), np.int32), np.full((n, length + 1), -1, np.int32)
        lone = np.zeros((n, length + 1), bool)
        for a in range(0, length, step):
            lo, hi = max(0, a - reach), min(length, a + step)
            cut = slice(lo, hi + 1)
            self._walk(points[:, lo:hi], counts[:, cut], last[:, cut], lone[:, cut], a - lo, lo == 0)
        return counts, lone

    def _walk(self, points, counts, last, lone, begin, at_start) -> None:
        n, length = points.shape
        widths = list(range(1, min(length, self.index.longest) + 1))
        cells = []
        for w, h in zip(widths, PieceIndex.rolled(points, widths), strict=True):
            ids = self.index.find(h)
            ids = np.where(ids < 0, self.other, ids) if w == 1 else np.where(self.whole[ids] & (ids >= 0), ids, -1)
            cells.append((w, ids))
        size = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
        for i in range(begin + 1, length + 1):
            open_ = np.ones(n, bool)
            for w, ids in reversed(cells):
                if w > i:
                    continue
                token = ids[:, i - w]
                rows = np.flatnonzero(open_ & (token >= 0))
                t, before = token[rows], last[rows, i - w]
                if i > w or not at_start:
                    fits = (before == self.other) | (t == self.other)
                    ask = np.flatnonzero(~fits & (before >= 0))
                    fits[ask] = self.may_follow(before[ask], t[ask])
                    rows, t = rows[fits], t[fits]
                last[rows, i] = t
                counts[rows, i] = counts[rows, i - w] + np.where(t == self.other, size[rows, i - 1], 1)
                lone[rows, i] = lone[rows, i - w] if i > w or not at_start else w == 1
                open_[rows] = False

    @staticmethod
    def split(text: str) -> list[str]:
        """The segments; a mark leads the text, and white space other than the blank is an ordinary character."""
        return _SEGMENT.findall(" " + text.replace(MARK, " "))

    def texts(self, texts: list[str | None]) -> list[int]:
        cut = [self.split(t) if t else [] for t in texts]
        if len(self.known) > MEMO_SEGMENTS:
            self.known.clear()
        new = list(set().union(*cut).difference(self.known))
        if new:
            self.known.update(zip(new, self.segments([s.replace(" ", MARK) for s in new]), strict=True))
        return [sum(map(self.known.__getitem__, c)) for c in cut]


class Prefixes:
    """The token count at every prefix of one text: budgets and truncations without another encoding."""

    def __init__(self, counter: PieceCounter, text: str):
        parts, total, counts = counter.split(text) if text else [], 0, [np.zeros(1, np.int64)]
        for s in (p.replace(" ", MARK) for p in parts):
            marks = len(s) - len(s.lstrip(MARK))
            run = np.array([counter.run_count(k) for k in range(1, marks + 1)], np.int64)
            own = run
            if marks < len(s):
                points = np.frombuffer(s[max(0, marks - 1) :].encode("utf-32-le"), np.uint32)[None]
                walked, lone = counter._long(points)
                first = 1 + (marks > 0)  # prefixes that go beyond the marks
                word = counter.behind_run(np.full(walked.shape[1] - first, marks), walked[0, first:], lone[0, first:])
                own = np.concatenate([run, word])
            counts.append(own + total)
            total += int(own[-1])
        self.counts = np.concatenate(counts)[1:]  # at 0: the mark that leads the text, which stands for no character
        self.empty = not text

    def tokens(self, characters: int) -> int:
        """Tokens of the text's first ``characters`` characters."""
        return 0 if self.empty or characters == 0 else int(self.counts[characters])

    def cut(self, budget: int) -> int:
        """The most leading characters whose encoding has at most ``budget`` tokens."""
        if self.empty:
            return 0
        fits = np.flatnonzero(self.counts[1:] <= budget)
        return int(fits[-1]) + 1 if len(fits) else 0


@lru_cache(maxsize=2)
def load(path: str) -> PieceCounter:
    """One counter a worker process."""
    return PieceCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """The contract's row for each document."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for batch in batches:
            for a, b in blocks(batch.column(1), BLOCK_BYTES):
                texts = batch.column(1).slice(a, b - a)
                n = np.array(counter.texts(texts.to_pylist()), np.int64)
                size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
