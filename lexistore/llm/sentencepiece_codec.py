"""SentencePiece BPE encoding and decoding over a merge-type prefix table.

The last token of the encoding of a prefix is unique.  For each prefix of a piece of text
the table stores that token: an automaton gives the vocabulary entries that end there,
longest first, and the first one that may stand behind the stored last token of the
shorter prefix is taken.  Two tokens may stand side by side if no merge across their border
would have come before the merges that built them (``Vocabulary.compatible``).  Walking
back from the last prefix recovers the ids.  The work is linear in the text's length.

A text is cut where no vocabulary entry can reach across: between a character and a
following space mark.  Runs of space marks all have one merge priority, so they follow
their own rule (grow the leftmost).  Characters outside the vocabulary become byte tokens.

Defined cases: a null or empty text has no ids and decodes to the empty text.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

MARK = "▁"
UNIT = re.compile(rf"{MARK}*[^{MARK}]+|{MARK}+")
NEVER = 1 << 60


class Vocabulary:
    """Ids, merge priorities and split pairs of a BPE model file with byte fallback."""

    def __init__(self, model_file: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(size)]
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte fallback")
        self.silent = {i for i in range(size) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        self.plain = frozenset(i for i in range(size) if not special[i])
        self.id_of = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id_of):
            raise ValueError("a piece has a space mark behind another character")
        self.runs = sorted((len(p) for p in self.id_of if not p.strip(MARK)), reverse=True)
        # rank: merges of a lower rank come first
        self.rank = {p: -sp.get_score(i) for p, i in self.id_of.items()}
        merged = [p for p in self.id_of if len(p) > 1 and p.strip(MARK)]
        self.split: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.id_of:
            if len(p) == 1:
                self.automaton.add_word(p, (self.id_of[p], len(p)))
        for p in sorted(merged, key=self.rank.__getitem__):
            parts = self._merge_all(p)
            if len(parts) == 1:  # else no text ever encodes to it
                self.split[p] = self._last_pair
                self.automaton.add_word(p, (self.id_of[p], len(p)))
        self.automaton.make_automaton()
        self.characters = frozenset(p for p in self.id_of if len(p) == 1)
        self._pairs: dict[int, bool] = {}

    def _merge_all(self, text: str) -> list[str]:
        """Plain BPE of a vocabulary entry; notes the last pair merged."""
        parts = list(text)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.rank.get(parts[i] + parts[i + 1], NEVER), i))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            self._last_pair = (parts[best], parts[best + 1])
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether ``left`` may be followed by ``right`` in an encoding.

        Follows the two pieces at the border as they grow: on the left the pieces that end
        there, on the right those that start there.  At every moment the border holds if
        merging across it comes later than the next growth of either side.  Of equal
        ranks the leftmost merge comes first.
        """
        ends, starts = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        good = True
        while good:
            across = self.rank.get(ends[i] + starts[j], NEVER)
            grow_left = self.rank[ends[i + 1]] if i + 1 < len(ends) else NEVER
            grow_right = self.rank[starts[j + 1]] if j + 1 < len(starts) else NEVER
            if across < grow_left and across <= grow_right and across != NEVER:
                good = False
            elif grow_left == NEVER and grow_right == NEVER:
                break
            elif grow_left <= grow_right:
                i += 1
            else:
                j += 1
        return good

    def _spine(self, piece: str, side: int) -> list[str]:
        """The pieces at one end of a token, from the single character up to the token."""
        out = [piece]
        while piece in self.split:
            piece = self.split[piece][side]
            out.append(piece)
        return out[::-1]

    def _known(self, text: str) -> list[int]:
        """Ids of a text of known characters with at most one space mark, in front.

        The automaton gives the entries by their end, longest first, so the prefix table
        is complete below an entry's start when the entry comes up.
        """
        last = [-1] * (len(text) + 1)  # the prefix table
        pairs, pieces, size = self._pairs, self.pieces, len(self.pieces)
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                before = last[end - length] if end > length else token
                if end > length:
                    pair = before * size + token
                    good = pairs.get(pair)
                    if good is None:
                        if len(pairs) >= 1 << 19:
                            pairs.clear()
                        good = pairs[pair] = self.compatible(pieces[before], pieces[token])
                    if not good:
                        continue
                last[end] = token
        ids, end = [], len(text)
        while end:
            ids.append(last[end])
            end -= len(pieces[last[end]])
        ids.reverse()
        return ids

    def unit(self, text: str) -> list[int]:
        """Ids of one unit: space marks, then other characters."""
        word = text.lstrip(MARK)
        marks = len(text) - len(word)
        ids: list[int] = []
        if word:
            at, known = 0, self.id_of
            word = (MARK if marks else "") + word
            marks = max(0, marks - 1)
            if self.characters.issuperset(word):
                ids, at = self._known(word), len(word)
            while at < len(word):
                end = at
                while end < len(word) and word[end] in known:
                    end += 1
                if end > at:
                    ids += self._known(word[at:end])
                at = end
                while at < len(word) and word[at] not in known:
                    ids += [self.byte_id[b] for b in word[at].encode("utf-8", "surrogatepass")]
                    at += 1
            if marks and ids[0] == known.get(MARK):  # a mark that found no word joins the run
                marks, ids = marks + 1, ids[1:]
        return self._run(marks) + ids

    def _run(self, marks: int) -> list[int]:
        out = []
        while marks:
            size = next(k for k in self.runs if k <= marks)
            out.append(self.id_of[MARK * size])
            marks -= size
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(model_file: str) -> Vocabulary:
    return Vocabulary(model_file)


class Codec:
    """Encodes and decodes whole texts; remembers units in two generations of ``limit`` each.

    When the young generation is full it becomes the old one; a unit met again moves up, so
    frequent units stay whatever passes through.
    """

    def __init__(self, model_file: str, limit: int = 1 << 18):
        self.vocabulary = vocabulary(model_file)
        self.limit = limit
        self._young: dict[str, tuple[int, str, str]] = {}
        self._old: dict[str, tuple[int, str, str]] = {}

    def _unit(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids as text, the decoded text: no containers, so Python's collector passes over them."""
        entry = self._old.get(text)
        if entry is None:
            ids = self.vocabulary.unit(text)
            entry = len(ids), ",".join(map(str, ids)), self._surface(ids)
        if len(text) <= 64:
            if len(self._young) >= self.limit:
                self._old, self._young = self._young, {}
            self._young[text] = entry
        return entry

    @staticmethod
    def units(text: str) -> list[str]:
        if not text:
            return []
        return UNIT.findall(MARK + text.replace(" ", MARK))

    def entries(self, text: str | None) -> list[tuple[int, str, str]]:
        make = self._unit
        return [self._young.get(u) or make(u) for u in self.units(text or "")]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, ids, _ in self.entries(text) for i in ids.split(",")]

    def _surface(self, ids: list[int]) -> str:
        """Text of ids, space marks as spaces; a run of byte tokens is read as UTF-8."""
        v, out, raw = self.vocabulary, [], bytearray()
        if v.plain.issuperset(ids):
            return "".join([v.pieces[i] for i in ids]).replace(MARK, " ")

        def flush() -> None:
            at = 0
            while at < len(raw):  # a byte that starts no valid character stands alone
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(raw[at : at + size]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    size = 1
                at += size
            raw.clear()

        for i in ids:
            if i in v.byte_of:
                raw.append(v.byte_of[i])
                continue
            flush()
            if i == v.unknown:
                out.append(" ⁇ ")
            elif i not in v.silent:
                out.append(v.pieces[i].replace(MARK, " "))
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the space that encoding puts in front is taken off again."""
        ids = [i for i in ids if i not in self.vocabulary.silent]
        text = self._surface(ids)
        starts_with_mark = bool(ids) and self.vocabulary.pieces[ids[0]].startswith(MARK)
        return text[1:] if starts_with_mark else text


@functools.lru_cache(maxsize=1)
def shared_codec(model_file: str) -> Codec:
    """One codec for all tasks that a worker process runs."""
    return Codec(model_file)


def encode_documents(docs: DataFrame, model_file: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int).

    A row for each row of ``docs``; rows are independent, extra columns are ignored.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(model_file)
        for batch in batches:
            counts, id_sums, text_sums, all_ids = [], [], [], []
            for text in batch.column("text").to_pylist():
                entries = codec.entries(text)
                counts.append(sum([e[0] for e in entries]))
                id_sums.append(hashlib.sha256(",".join([e[1] for e in entries]).encode()).hexdigest())
                decoded = "".join([e[2] for e in entries])[1:]  # without the space put in front
                text_sums.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                if with_ids:
                    all_ids.append([int(i) for e in entries for i in e[1].split(",")])
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(run, schema)
