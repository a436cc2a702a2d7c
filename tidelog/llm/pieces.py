"""SentencePiece BPE encoding by a merge-type prefix table, and decoding.

A BPE encoding has one last token for each prefix of a text. Token t can end the prefix that stops
where t does iff the last token a of what comes before t and t are compatible: the merges of a + t
give exactly [a, t]. So one pass over the pieces that an Aho-Corasick automaton finds fills a table
of last tokens, and walking that table from the end gives the ids, in time linear in the text,
however long a run without spaces is.

Merges never cross from a letter to a following space mark when no piece has a mark after another
letter (checked on load), and never touch a letter that is no piece. Text is cut there; words
repeat, so their ids are kept in a bounded table.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.common import spread

MARK = "▁"
KEPT = 200_000  # words whose ids a worker keeps, twice: the latest and those before


class PieceEncoder:
    """The encoder of one model file. encode() and decode() need nothing of the sentencepiece library but its normalizer."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalize = sp.normalize
        ids = range(sp.vocab_size())
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.piece = {i: sp.id_to_piece(i) for i in plain}
        self.id = {p: i for i, p in self.piece.items()}
        self.rank = {p: -sp.get_score(i) for p, i in self.id.items()}
        self.byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in ids if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.surface = [self.piece.get(i, "").replace(MARK, " ").encode() for i in ids]
        for b, i in self.byte.items():
            self.surface[i] = bytes([b])
        self.surface[self.unknown] = " ⁇ ".encode()
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.id)
        self.automaton = ahocorasick.Automaton()
        self.steps: dict[int, list[tuple[float, str, str]]] = {}
        for p, i in self.id.items():
            whole, self.steps[i] = self._merges(p)
            if whole == [p]:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        letters = "".join(re.escape(p) for p in self.id if len(p) == 1)
        inner = letters.replace(re.escape(MARK), "") if self.cuts else letters
        self.cut = re.compile(f"{MARK}*[{inner}]+|{MARK}+|[^{letters}]" if self.cuts else f"[{letters}]+|[^{letters}]").findall
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _merges(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """BPE by its definition, for short strings: the best-ranked neighbours join first, the leftmost of equals.

        Returns what is left, and for each merge its rank and the first and last symbol after it.
        """
        s, rank, steps = list(text), self.rank, []
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                r = rank.get(s[i] + s[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
            steps.append((best, s[0], s[-1]))
        return s, steps

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges of piece a + piece b give [a, b].

        As long as nothing joins across the border, each side merges as it would alone, the better
        rank first and the left side first of equals. A pair across the border joins if it ranks
        before the next merge on the left and not after the next one on the right.
        """
        p, q, rank = self.piece[a], self.piece[b], self.rank
        left, right = self.steps[a], self.steps[b]
        x, y, i, j = p[-1], q[0], 0, 0
        end = float("inf")
        while True:
            across = rank.get(x + y, end)
            l = left[i][0] if i < len(left) else end  # noqa: E741
            r = right[j][0] if j < len(right) else end
            if across < l and across <= r and across < end:
                return False
            if l == end and r == end:
                return True
            if l <= r:
                x, i = left[i][2], i + 1
            else:
                y, j = right[j][1], j + 1

    def _run(self, text: str) -> tuple[int, ...]:
        """Ids of a text all of whose letters are pieces."""
        last = [-1] * len(text)
        width = [0] * len(text)
        pairs = self.pairs
        for end, (t, n) in self.automaton.iter(text):
            if width[end]:
                continue
            if end >= n:
                a = last[end - n]
                if a < 0:
                    continue
                key = a << 24 | t
                ok = pairs.get(key)
                if ok is None:
                    if len(pairs) >= 4 * KEPT:
                        pairs.clear()
                    ok = pairs[key] = self.compatible(a, t)
                if not ok:
                    continue
            last[end], width[end] = t, n
        out, i = [], len(text) - 1
        while i >= 0:
            if not width[i]:
                raise AssertionError("a prefix has no last token")
            out.append(last[i])
            i -= width[i]
        return tuple(out[::-1])

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of a mark and a word. Words not seen since the table last filled up go; no id depends on that."""
        ids = self.older.get(word)
        if ids is None:
            ids = tuple([i for c in self.cut(MARK + word) for i in self._part(c)])
        if len(word) <= 48:
            if len(self.words) >= KEPT:
                self.older, self.words = self.words, {}
            self.words[word] = ids
        return ids

    def _part(self, text: str) -> tuple[int, ...]:
        """Ids of a part between cuts."""
        if len(text) > 1 or text in self.id:
            return self._run(text)
        return tuple(self.byte[b] for b in text.encode()) if self.byte else (self.unknown,)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        norm = self.normalize(text)
        if not self.cuts:
            return [i for c in self.cut(norm) for i in self._part(c)]
        words = norm.split(MARK)
        out: list[int] = []
        if words[0] or "" in words[1:]:  # no mark at the start, or a run of marks: cut with care
            for c in self.cut(norm):
                out += self._part(c)
            return out
        known = self.words.get
        for w in words[1:]:
            ids = known(w)
            if ids is None:
                ids = self._word(w)
                known = self.words.get
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding puts first goes. Each byte that is no part of UTF-8 becomes U+FFFD."""
        surface = self.surface
        return b"".join([surface[i] for i in ids]).decode("utf-8", "tidelog_each_byte").removeprefix(" ")


codecs.register_error("tidelog_each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


@cache
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and piece_ids of every whole text. Null text counts as empty; repeated rows stay; other columns play no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                ids = [e.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "piece_ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece_ids array<int>")


def decoded(ids: DataFrame, model: str) -> DataFrame:
    """doc_id and text of (doc_id, piece_ids). Null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = [e.decode(x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select(ids["doc_id"].cast("long").alias("doc_id"), "piece_ids").mapInArrow(run, "doc_id long, text string")


def fingerprints(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the text they decode to, for every whole text.

    Ids are read as decimals joined by commas. One pass, without a shuffle unless a scan has too few splits: a text is encoded, decoded
    from its ids and digested in the task that reads it. Nulls, ties and clashes as in encoded().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        number = [str(i) for i in range(len(e.surface))]
        for b in batches:
            counts, a, z = [], [], []
            for t in b.column(1):
                ids = e.encode(t.as_py() or "")
                counts.append(len(ids))
                a.append(hashlib.sha256(",".join([number[i] for i in ids]).encode()).hexdigest())
                z.append(hashlib.sha256(e.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(a), pa.array(z)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return spread(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
