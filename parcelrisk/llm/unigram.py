"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary piece that occurs in a
word; dynamic programming carries the best score and, in place of a path, the
number of pieces on it.  Tie rule of the tokenizer: a candidate replaces the
best path to its end only if its score is strictly greater, and candidates
come by ascending start, so among equals the longest last piece wins.  A
character that no one-character piece matches is unknown, at the least score
minus 10; with byte pieces in the vocabulary it counts as its UTF-8 bytes,
else a run of unknown characters counts as one piece.

Texts are cut into words as the metaspace rule does: a space and U+2581 both
start a word, and a text without one at its front gets one.  Each batch counts
its different words once, all words of similar length together.

Edge cases: a null or empty text has no pieces.  Rows are counted one by one,
so null ids, repeated rows and ties between rows need no rule.  Words too long
to be worth a batch go through the same search one by one.  Other input
columns pass through; one named like a result is replaced.  An empty table
gives an empty result.
"""

from __future__ import annotations

from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col

SPACE = "▁"
_SEP = "\0"              # no piece holds it; words that do are counted singly
_CHUNK = 200_000         # characters of different words searched at a time
_LONG = 200              # longer words are searched singly
_TEXT_CHUNK = 8 << 20


class Unigram:
    def __init__(self, vocab: list[tuple[str, float]], unk_id: int, byte_fallback: bool):
        self.score = np.array([s for _, s in vocab], np.float64)
        self.size = np.array([len(p) for p, _ in vocab], np.int64)
        self.unk_score = float(self.score.min()) - 10.0
        have = {p for p, _ in vocab}
        self.bytes = byte_fallback and all(f"<0x{i:02X}>" in have for i in range(256))
        self.automaton = ahocorasick.Automaton()
        for i, (p, _) in enumerate(vocab):
            if p:
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.unk_id = unk_id

    @classmethod
    def from_sentencepiece(cls, path: str) -> Unigram:
        """Pieces and scores of a model file (its kind of search is not used)."""
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        vocab = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
        return cls(vocab, sp.unk_id(), True)

    def _unknown(self, char: str) -> int:
        return len(char.encode("utf-8", "surrogatepass")) if self.bytes else 1

    def count_one(self, word: str) -> tuple[int, float]:
        """(pieces, score) of one word, in memory bounded by the longest piece."""
        best, count, unk = [0.0], [0], [False]
        longest = int(self.size.max())
        matches = self.automaton.iter(word)
        pending = next(matches, None)
        base = 0                           # best[0] belongs to this position
        for end in range(1, len(word) + 1):
            by_end = []
            while pending is not None and pending[0] + 1 == end:
                by_end.append(pending[1])
                pending = next(matches, None)
            by_end.sort(key=lambda i: -self.size[i])
            top, n, u = -np.inf, 0, False
            single = False
            for i in by_end:
                src = end - int(self.size[i]) - base
                single |= self.size[i] == 1
                s = best[src] + float(self.score[i])
                if s > top:
                    top, n, u = s, count[src] + 1, False
            if not single:
                src = end - 1 - base
                s = best[src] + self.unk_score
                if s > top:
                    more = self._unknown(word[end - 1])
                    top, u = s, True
                    n = count[src] + (more if self.bytes or not unk[src] else 0)
            best.append(top)
            count.append(n)
            unk.append(u)
            if len(best) > 4096 + longest:
                drop = len(best) - longest - 1
                del best[:drop], count[:drop], unk[:drop]
                base += drop
        return count[-1], float(best[-1])

    def count_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, scores) of many words."""
        n = np.zeros(len(words), np.int64)
        score = np.zeros(len(words), np.float64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        part: list[int] = []
        chars = 0
        for i in np.argsort(sizes, kind="stable").tolist():
            if sizes[i] > _LONG or _SEP in words[i]:
                n[i], score[i] = self.count_one(words[i])
                continue
            part.append(i)
            chars += int(sizes[i]) + 1
            if chars >= _CHUNK:
                n[part], score[part] = self._search([words[j] for j in part], sizes[part])
                part, chars = [], 0
        if part:
            n[part], score[part] = self._search([words[j] for j in part], sizes[part])
        return n, score

    def _search(self, words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        joined = _SEP.join(words)
        starts = np.cumsum(sizes + 1) - sizes - 1
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64)
        ends, piece = found[::2] + 1, found[1::2]
        length, value = self.size[piece], self.score[piece]
        # the characters that no one-character piece matches
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        owner = np.repeat(np.arange(len(words)), sizes)
        inside = np.arange(len(owner)) + owner        # joined position of each word character
        alone = np.zeros(len(code) + 1, bool)
        alone[ends[length == 1]] = True
        lost = inside[~alone[inside + 1]]
        c = code[lost]
        cost = 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF) if self.bytes \
            else np.ones(len(lost), np.int64)
        ends = np.r_[ends, lost + 1]
        pieces = np.r_[np.ones(len(length), np.int64), cost]
        known = np.r_[np.ones(len(length), bool), np.zeros(len(lost), bool)]
        length = np.r_[length, np.ones(len(lost), np.int64)]
        value = np.r_[value, np.full(len(lost), self.unk_score)]
        # nodes are joined positions; a word's first node has score 0.  Edges go
        # by their end within the word, then by falling length (ascending start)
        node_start = np.zeros(len(code) + 1, np.int64)
        node_start[inside + 1] = np.repeat(starts, sizes)
        within = ends - node_start[ends]
        key = within * 256 + (255 - np.minimum(length, 255))
        order = np.argsort(key, kind="stable")
        key, ends, length = key[order], ends[order], length[order]
        value, pieces, known = value[order], pieces[order], known[order]
        best = np.full(len(code) + 1, -np.inf)
        best[starts] = 0.0
        count = np.zeros(len(code) + 1, np.int64)
        unk = np.zeros(len(code) + 1, bool)
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)
        for s, e in zip(cuts, np.r_[cuts[1:], len(key)]):
            to = ends[s:e]
            src = to - length[s:e]
            new = best[src] + value[s:e]
            up = new > best[to]
            to, src = to[up], src[up]
            ok = known[s:e][up]
            more = pieces[s:e][up]
            if not self.bytes:
                more = np.where(~ok & unk[src], 0, more)
            best[to], count[to], unk[to] = new[up], count[src] + more, ~ok
        last = starts + sizes
        return count[last], best[last]


_LOADED: dict[str, Unigram] = {}


def load(path: str) -> Unigram:
    if path not in _LOADED:
        _LOADED[path] = Unigram.from_sentencepiece(path)
    return _LOADED[path]


def count_texts(model: Unigram, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, scores) of whole texts."""
    total = np.zeros(len(texts), np.int64)
    score = np.zeros(len(texts), np.float64)
    at = 0
    while at < len(texts):
        part, rows, size = [], [], 0
        while at < len(texts) and (not part or size < _TEXT_CHUNK):
            t = (texts[at] or "").replace(SPACE, " ")
            if t:
                part.append(t[1:] if t[0] == " " else t)
                rows.append(at)
                size += len(t)
            at += 1
        if not part:
            continue
        split = pc.split_pattern(pa.array(part, pa.large_string()), " ")
        words = split.flatten().dictionary_encode()
        n, s = model.count_words([SPACE + w for w in words.dictionary.to_pylist()])
        codes = words.indices.to_numpy(zero_copy_only=False)
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        total[rows] = np.add.reduceat(n[codes], bounds[:-1])
        score[rows] = np.add.reduceat(s[codes], bounds[:-1])
    return total, score


def unigram_token_counts(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """The other columns of ``docs`` with ``n_tokens`` and ``score`` (the best
    path's) in place of the text."""
    rest = [c for c in docs.columns
            if c != text_col and c.lower() not in ("n_tokens", "score")]
    src = docs.select(col(text_col), *map(col, rest))
    schema = src.select(*map(col, rest), F.lit(0).cast("long").alias("n_tokens"),
                        F.lit(0.0).alias("score")).schema

    def run(batches):
        for b in batches:
            n, s = count_texts(load(model_path), b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array(n), pa.array(s)], [*rest, "n_tokens", "score"])

    return src.mapInArrow(run, schema)
