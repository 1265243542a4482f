"""SentencePiece encoding and decoding with a merge-type (BPE) model, by backtracking.

A sequence of pieces is the one that merging gives exactly if merging any two neighbours on their own gives these two again.
So the encoder takes the longest piece at each place (Aho-Corasick), tries shorter ones while a neighbour doesn't fit, and
steps back where none does. A bit for each place says that no encoding goes on from there, so that no place is tried twice.

A text is first cut where no piece of the model can hold both characters, which changes no result; short parts are remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

#: The sign that stands for a space in pieces.
SPACE = "▁"
#: Parts up to this length are remembered, so many in a worker; the same number of neighbours.
SHORT, REMEMBERED = 48, 1_000_000
#: Characters whose matches are held at once.
BLOCK = 1 << 14
#: Characters of texts in one batch of results.
BATCH_CHARS = 4_000_000


class _Parts(dict):
    """part: its ids as bytes."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, part: str) -> bytes:
        ids = self.encode(part)
        if len(part) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = ids
        return ids


class Pieces:
    """The pieces and scores of a merge-type model file, and what the encoder remembers."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        if lib.serialized_model_proto() and any(lib.is_unused(i) for i in range(lib.get_piece_size())):
            raise ValueError("models with unused pieces are split again after merging and aren't covered")
        own = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.piece = {i: lib.id_to_piece(i) for i in own}
        self.score = {p: lib.get_score(i) for i, p in self.piece.items()}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = lib.is_byte(self.bytes[0])
        self.longest = max(map(len, self.score))
        self.search = ahocorasick.Automaton()
        for i, p in self.piece.items():
            self.search.add_word(p, (len(p), i))
        self.search.make_automaton()
        self.cut = self._cutter()
        self.merges: dict[int, list[tuple]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.parts = _Parts(self.encode_part)

    def _cutter(self) -> re.Pattern:
        """Parts of a text: spaces and then characters that share pieces, directly or by way of others."""
        group: dict[str, str] = {}

        def of(x: str) -> str:
            while group.setdefault(x, x) != x:
                x = group[x]
            return x

        for p in self.score:
            body = p.lstrip(SPACE)
            if SPACE in body:
                return re.compile(".+", re.S)
            for a, b in zip(body, body[1:]):
                group[of(a)] = of(b)
        sets: dict[str, list[str]] = {}
        for x in group:
            sets.setdefault(of(x), []).append(x)
        runs = ["[" + re.escape("".join(sorted(s))) + "]+" for s in sorted(sets.values(), key=len, reverse=True)]
        return re.compile(f"{SPACE}*(?:{'|'.join([*runs, f'[^{SPACE}]'])})|{SPACE}+", re.S)

    def text_of(self, token: int) -> str:
        """Of an id, or of -1 - c for a character c that is no piece."""
        return chr(-1 - token) if token < 0 else self.piece[token]

    def history(self, token: int) -> list[tuple] | None:
        """What merging a piece's characters does: (score of the next merge, first symbol, last symbol) before each merge and at the end.

        None if the characters don't come together to the piece.
        """
        symbols = list(self.text_of(token))
        states = []
        while True:
            best, at = None, 0
            for k in range(len(symbols) - 1):
                s = self.score.get(symbols[k] + symbols[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            states.append((best, symbols[0], symbols[-1]))
            if best is None:
                return states if len(symbols) == 1 else None
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]

    def remembered(self, token: int) -> list[tuple] | None:
        if token not in self.merges:
            if len(self.merges) >= REMEMBERED:
                self.merges.clear()
            self.merges[token] = self.history(token)
        return self.merges[token]

    def fit(self, a: int, b: int) -> bool:
        """Merging the characters of both never merges across their border: the merges of either are done again, best score first, leftmost of equals."""
        left, right = self.remembered(a), self.remembered(b)
        if left is None or right is None:
            return False
        i = j = 0
        while True:
            (sa, _, last), (sb, first, _) = left[i], right[j]
            across = self.score.get(last + first)
            if across is not None and (sa is None or across > sa) and (sb is None or across >= sb):
                return False
            if sa is None and sb is None:
                return True
            if sb is None or sa is not None and sa >= sb:
                i += 1
            else:
                j += 1

    def matches(self, part: str, start: int, stop: int) -> list[list[tuple[int, int]]]:
        """For each place from `start` to `stop`: (length, id) of all pieces there, longest last; a character that is no piece stands for itself."""
        found: list[list[tuple[int, int]]] = [[] for _ in range(start, stop)]
        for end, match in self.search.iter(part, start, min(len(part), stop + self.longest)):
            at = end - match[0] + 1 - start
            if 0 <= at < len(found):
                found[at].append(match)
        for k, own in enumerate(found):
            if not own or own[0][0] > 1:
                own.insert(0, (1, -1 - ord(part[start + k])))
        return found

    def backtrack(self, part: str) -> list[int]:
        """The tokens of a part; ids, or -1 - c for a character c that is no piece."""
        size = len(part)
        blocks: dict[int, list] = {}

        def at(place: int) -> list[tuple[int, int]]:
            b = place // BLOCK
            if b not in blocks:
                if len(blocks) > 2:
                    blocks.pop(min(blocks) if b > min(blocks) else max(blocks))
                blocks[b] = self.matches(part, b * BLOCK, min(size, (b + 1) * BLOCK))
            return blocks[b][place % BLOCK]

        fits = self.fits
        if len(fits) > REMEMBERED:
            fits.clear()
        failed = bytearray(size + 1)
        tokens: list[int] = []
        tries: list[int] = []  # which of its place's matches each token is
        place, options = 0, at(0)
        k = len(options) - 1
        while True:
            last = tokens[-1] if tokens else None
            while k >= 0:
                length, token = options[k]
                if not failed[place + length]:
                    if last is None:
                        if self.remembered(token) is not None:
                            break
                    else:
                        pair = (last, token)
                        ok = fits.get(pair)
                        if ok is None:
                            ok = fits[pair] = self.fit(last, token)
                        if ok:
                            break
                k -= 1
            if k >= 0:
                tokens.append(token)
                tries.append(k)
                place += length
                if place == size:
                    return tokens
                options = at(place)
                k = len(options) - 1
            else:
                failed[place] = 1
                k = tries.pop()
                token = tokens.pop()
                place -= 1 if token < 0 else len(self.piece[token])
                options = at(place)
                k -= 1

    def encode_part(self, part: str) -> bytes:
        ids: list[int] = []
        for token in self.backtrack(part):
            if token >= 0:
                ids.append(token)
            elif self.fallback:
                ids.extend(self.bytes[b] for b in chr(-1 - token).encode("utf-8", "surrogatepass"))
            else:
                ids.append(self.library.unk_id())
        return np.array(ids, dtype=np.int32).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text without begin or end ids; a null text is empty."""
        if not text:
            return np.empty(0, dtype=np.int32)
        find = self.parts.__getitem__
        return np.frombuffer(b"".join([find(m) for m in self.cut.findall(self.library.normalize(text))]), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist()) if len(ids) else ""


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string): the ids of each whole text, and the text that they stand for.

    One row for each row, repeated or not; a null or empty text has no ids and decodes to the empty text; a null id stays null; an
    empty table gives no rows; other columns are not read. `model` is a merge-type model file that every worker can read. A text
    of any length is encoded in memory that grows with that text alone. Without byte pieces in the model, each character
    that is no piece is one unknown id.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def out(doc_ids: list, ids: list[np.ndarray], decoded: list[str]) -> pa.RecordBatch:
        ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        flat = pa.array(np.concatenate(ids) if ids else np.empty(0, dtype=np.int32), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(decoded, pa.string())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces(model)
        doc_ids, ids, decoded, held = [], [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                own = coder.encode(text.as_py())
                doc_ids.append(doc_id)
                ids.append(own)
                decoded.append(coder.decode(own))
                held += len(decoded[-1])
                if held >= BATCH_CHARS or len(ids) >= 5000:
                    yield out(doc_ids, ids, decoded)
                    doc_ids, ids, decoded, held = [], [], [], 0
        if ids:
            yield out(doc_ids, ids, decoded)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")
