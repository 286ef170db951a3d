"""SentencePiece encoding of merge-type (BPE) models by a prefix table, and decoding.

Every prefix of a text has one encoding, so one last token. The table stores it
for each prefix: among the pieces that end there (one pass of an automaton finds
them all), it is the one that follows the last token of the prefix before it in
a compatible way, that is, the two texts joined are encoded as these two
tokens. Neighbours that are compatible make the whole encoding, so following the
table backwards from the end gives the ids. Time is linear in the text, however
long its words are.

No piece has a space behind another sign, nor (read from the model) a letter
next to another sign than a leading space, so texts are cut there, and each
distinct unit is encoded once for as long as a bounded memory holds it. Pieces of spaces alone are merged last of all (their pair has the
least score), so a run of spaces is encoded after the word behind it has taken
its own. Characters that no piece holds become their bytes' pieces.

Decoding joins the pieces' texts; bytes that are no UTF-8 become U+FFFD one by
one, control ids nothing, the unknown id its sign, and the first piece loses the
space that encoding put before the text.

Defined cases: null and empty texts are the begin and end ids, and decode to '';
U+2581 is a space; very long texts are cut in segments before spaces, and a
long word needs a table of its length; rows are taken one by one, so repeated
rows, null ids and empty tables need no rule; an input column of the output's
name is replaced.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterable
from functools import cache, lru_cache
from math import inf

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplospark.llm.common import map_texts, table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
UNIT_START = re.compile("(?<! ) ")
#: Characters of a text that are cut into units at once; more if a unit is longer.
SEGMENT = 1 << 20
#: Units that a worker remembers, and last tokens before a piece; longer units are not remembered.
MEMORY, MEMORY_CHARS, MEMORY_BEFORE = 1 << 19, 64, 1 << 12


class Remembered(dict):
    """A dict that makes what it misses, and begins anew when it is full."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMORY:
            self.clear()
        made = self.make(key)
        if len(key) <= MEMORY_CHARS:
            self[key] = made
        return made


class Behind(dict):
    """A piece, and before which last tokens it may stand: '' is the beginning; a character without a piece merges with nothing."""

    def __init__(self, piece: str, model: PieceModel):
        super().__init__()
        self.piece, self.size, self.model = piece, len(piece), model

    def __missing__(self, before: str) -> bool:
        if len(self) >= MEMORY_BEFORE:
            self.clear()
        whole = self.model.edges(self.piece) is not None or self.model.merged(self.piece)[0] == [self.piece]
        self[before] = whole and (before not in self.model.score or self.model.compatible(before, self.piece))
        return self[before]


def units(pieces: Iterable[str]) -> str:
    """A pattern of the units that no piece leaves: spaces with letters or with other signs behind them. Letters that stand next to another
    sign in some piece count as such."""
    signs, letter = "", re.compile(r"[^\W\d_]")
    pairs = {(a, b) for p in pieces for a, b in zip(p, p[1:]) if a != SPACE}
    while crossing := {a if letter.match(a) and a not in signs else b for a, b in pairs if bool(letter.match(a) and a not in signs) != bool(letter.match(b) and b not in signs)}:
        signs += "".join(sorted(crossing))
    kept = re.escape(signs)
    return rf" *[^\W\d_{kept}]+| *(?:[\d_{kept}]|[^\w ])+| +"


class PieceModel:
    """A merge-type model read from its file: pieces, their scores, bytes and control ids."""

    def __init__(self, path: str):
        read = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(read.get_piece_size())
        if read.normalize(" a　ﬁ  ") != f"{SPACE}{SPACE}a　ﬁ{SPACE}{SPACE}":
            raise ValueError("only models that leave texts as they are, behind a space, can be read")
        self.bos, self.eos, self.unknown = read.bos_id(), read.eos_id(), read.unk_id()
        self.control = {i for i in ids if read.is_control(i)}
        self.bytes = {read.piece_to_id(f"<0x{b:02X}>"): b for b in range(256)}
        plain = [i for i in ids if not (i in self.control or read.is_unknown(i) or read.is_byte(i))]
        self.id_of = {read.id_to_piece(i): i for i in plain}
        self.score = {p: read.get_score(i) for p, i in self.id_of.items()}
        of_byte = {b: i for i, b in self.bytes.items()}
        if any(not read.is_byte(i) for i in self.bytes) or len(self.bytes) < 256:
            raise ValueError("only models with pieces for bytes can be read")
        runs = [p for p in self.score if len(p) > 1 and SPACE in p[1:]]
        if any(p.strip(SPACE) for p in runs) or (runs and self.score.get(SPACE * 2, 1.0) > min(s for p, s in self.score.items() if len(p) > 1)):
            raise ValueError("only models can be read whose spaces stand first in a piece, or alone and merged last")
        self.packed = Remembered(lambda t: np.array([self.id_of[t]] if t in self.id_of else [of_byte[b] for b in t.encode()], "<u4").tobytes())
        self.spaces = Remembered(lambda run: b"".join(self.packed[t] for t in self.merged(run)[0]))
        self.units = Remembered(self.unit)
        self.cut = re.compile(units(self.score))
        self.automaton = ahocorasick.Automaton()
        for p in self.score:
            if p not in runs:
                self.automaton.add_word(p, Behind(p, self))
        self.automaton.make_automaton()
        self.text = {i: p.replace(SPACE, " ").encode() for p, i in self.id_of.items()} | {i: bytes([b]) for i, b in self.bytes.items()} | {i: b"" for i in self.control} | {self.unknown: " ⁇ ".encode()}

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The tokens of a short text or of a run of one sign, merge by merge: the best pair first, of equals the leftmost; and the last merge."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []
        latest = None

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts) and (score := self.score.get(parts[i] + parts[after[i]])) is not None:
                heapq.heappush(heap, (-score, i, parts[i] + parts[after[i]]))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != piece:
                continue  # one of the two has been merged since
            latest = parts[i], parts[j]
            parts[i], parts[j], after[i] = piece, None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [p for p in parts if p is not None], latest

    @cache
    def edges(self, piece: str) -> tuple[list[tuple[str, float]], list[tuple[str, float]]] | None:
        """What stands at the piece's left and right end while it is merged, each with the score of the merge that takes it in; None if the text of
        the piece is not encoded as the piece, or scores do not fall from merge to merge."""
        if len(piece) == 1:
            return [(piece, -inf)], [(piece, -inf)]
        parts, latest = self.merged(piece)
        if parts != [piece] or latest is None or not all(len(p) == 1 or self.score[p] > self.score[piece] for p in latest):
            return None
        left, right = (self.edges(p) for p in latest)
        if left is None or right is None:
            return None
        into = lambda edge: [*edge[:-1], (edge[-1][0], self.score[piece]), (piece, -inf)]
        return into(left[0]), into(right[1])

    def compatible(self, a: str, b: str) -> bool:
        """Whether the texts of both, joined, are encoded as the two: no merge over the border comes before those at its two sides."""
        mine, other = self.edges(a), self.edges(b)
        if mine is None or other is None:
            return self.merged(a + b)[0] == [a, b]
        i = j = 0
        while True:
            (left, left_goes), (right, right_goes) = mine[1][i], other[0][j]
            over = self.score.get(left + right)
            if over is not None and over > left_goes and over >= right_goes:  # of equal merges the left one comes first
                return False
            if left_goes == right_goes == -inf:
                return True
            if left_goes >= right_goes:
                i += 1
            else:
                j += 1

    def prefix_table(self, word: str) -> list[str]:
        """The last token of each prefix, the empty one first; a character without a piece is a token of its own."""
        last, end = [""], 0
        for at, behind in self.automaton.iter(word):
            if at < end:
                continue  # this prefix has its token
            while end < at:  # nothing ends here but a character without a piece
                last.append(word[end])
                end += 1
            if behind[last[at + 1 - behind.size]]:
                last.append(behind.piece)
                end = at + 1
        while end < len(word):
            last.append(word[end])
            end += 1
        return last

    def word(self, word: str) -> list[str]:
        """The tokens of a word, read backwards from the table."""
        last, at, tokens = self.prefix_table(word), len(word), []
        while at:
            tokens.append(last[at])
            at -= len(last[at])
        return tokens[::-1]

    def unit(self, unit: str) -> bytes:
        """The ids of a run of spaces and the word behind it."""
        word = unit.lstrip(" ")
        spaces = len(unit) - len(word)
        if not word:
            return self.spaces[SPACE * spaces]
        if not spaces:
            return b"".join(map(self.packed.__getitem__, self.word(word)))
        first, *rest = self.word(SPACE + word)
        run = self.spaces[SPACE * (spaces - (first != SPACE))] if spaces > 1 or first == SPACE else b""
        return run + b"".join(map(self.packed.__getitem__, rest if first == SPACE else [first, *rest]))

    def encode(self, text: str | None) -> bytes:
        """All ids of a text, begin and end ids too, as little-endian unsigned 32-bit numbers."""
        parts = [np.uint32(self.bos).tobytes()]
        if text:
            text, at = " " + text.replace(SPACE, " "), 0
            while at < len(text):
                cut = UNIT_START.search(text, at + SEGMENT) if len(text) - at > SEGMENT else None
                end = cut.start() if cut else len(text)
                parts += map(self.units.__getitem__, self.cut.findall(text, at, end))
                at = end
        parts.append(np.uint32(self.eos).tobytes())
        return b"".join(parts)

    def decode(self, packed: bytes) -> str:
        """The text of ids."""
        ids = np.frombuffer(packed, "<u4").tolist()
        joined = b"".join(map(self.text.__getitem__, ids))
        first = next((i for i in ids if i not in self.control), self.unknown)
        drop = first != self.unknown and first not in self.bytes and joined.startswith(b" ")
        try:
            if not (self.control.union((self.unknown,)) & set(ids[1:-1])):
                return joined.decode()[drop:]
        except UnicodeDecodeError:
            pass
        out, run = [], b""
        for i in [*ids, self.unknown]:
            if i in self.bytes:
                run += self.text[i]
                continue
            out.append(_lenient(run))
            out.append(self.text[i].decode())
            run = b""
        return "".join(out[:-1])[drop:]


def _lenient(run: bytes) -> str:
    """Bytes as UTF-8; each byte that begins no character is U+FFFD."""
    out, at = [], 0
    while at < len(run):
        for size in range(1, 5):
            try:
                out.append(run[at : at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            size = 1
        at += size
    return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def _with(df: DataFrame, name: str, kind: pa.DataType, sql: str, column: str, make: Callable[[pa.Array], list]) -> DataFrame:
    kept = df.select(*[c for c in df.columns if c.lower() != name.lower() or c == column])
    names = [c for c in kept.columns if c != name]
    schema = ", ".join([*(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in names), f"`{name}` {sql}"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(make(batch.column(column)), kind)], names=[*names, name])

    return map_texts(kept, column, schema, run)


def with_ids(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` and its texts' ids with begin and end ids: a binary column of little-endian unsigned 32-bit numbers."""
    where = path or public_tokenizers.path(MODEL)
    return _with(df, ids, pa.binary(), "binary", text, lambda texts: list(map(model(where).encode, texts.to_pylist())))


def with_text(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` and the texts of its ids; null ids have none."""
    where = path or public_tokenizers.path(MODEL)
    return _with(df, text, pa.string(), "string", ids, lambda packed: [None if p is None else model(where).decode(p) for p in packed.to_pylist()])


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = with_ids(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")
    decoded = with_text(encoded)
    return decoded.select("doc_id", F.expr("CAST(length(ids) / 4 AS bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
