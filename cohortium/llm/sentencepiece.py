"""SentencePiece BPE: encoding by vectorised merge rounds, and decoding.

The words of a run of texts lie in one flat array of symbols. A round looks up the rank of every neighbouring pair, takes
the minimum per word, merges the leftmost pairs of that rank in all words at once and compacts the array, until no word
has a pair left. The library merges the best pair of a text, leftmost first; a word here is a part of the text that no
piece crosses, so words are independent and equal words are merged once.

Several pairs of a word are merged in one round only if the new piece cannot be part of a better pair; else just the
leftmost one is.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import Memo, importable, slices

MARK = "▁"  # stands for a space inside pieces
SURFACE = " ⁇ "  # of the unknown piece
NONE = np.iinfo(np.int32).max


class Pieces:
    """Tables of a model file: symbols of characters, pairs with rank and result, bytes of every piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.end, self.unknown = model.eos_id(), model.unk_id()
        kinds = np.zeros(n, np.int8)  # 0 piece, 1 byte, 2 control or unknown
        self.byte_id = np.zeros(256, np.int32)
        pieces = [model.id_to_piece(i) for i in range(n)]
        for i, piece in enumerate(pieces):
            if model.is_byte(i):
                kinds[i] = 1
                self.byte_id[int(piece[3:5], 16)] = i
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                kinds[i] = 2
        self.kinds = kinds
        ids = {piece: i for i, piece in enumerate(pieces) if kinds[i] == 0}
        for piece in ids:
            if MARK in piece.lstrip(MARK):
                raise ValueError("a piece has a space behind other characters: words of this model are not independent")
        self.symbol = np.full(0x110000, -1, np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        scores = np.array([model.get_score(i) for i in range(n)])
        merged = np.array(sorted((i for i in ids.values() if len(pieces[i]) > 1), key=lambda i: (-scores[i], i)), np.int32)
        better = {score: at for at, score in enumerate(sorted({scores[i] for i in merged}, reverse=True))}
        self.rank_of = np.full(n, NONE, np.int32)
        for i in merged:
            self.rank_of[i] = better[scores[i]]
        left, right, whole = [], [], []
        careful = np.zeros(n, bool)
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                a, b = ids.get(piece[:cut]), ids.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    whole.append(i)
                    for part in (a, b):
                        careful[part] |= self.rank_of[part] != NONE and self.rank_of[i] <= self.rank_of[part]
        self.careful = careful
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_piece = keys[order], np.array(whole, np.int32)[order]
        self.text = [b"" if kinds[i] else piece.replace(MARK, " ").encode() for i, piece in enumerate(pieces)]
        for b, i in enumerate(self.byte_id):
            self.text[i] = bytes([b])
        self.text[self.unknown] = SURFACE.encode()

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Piece that each pair makes, -1 for none."""
        keys = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_piece[at], -1)

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge rounds over flat ``symbols`` of the words ``word``; symbols, words and sizes in characters that remain."""
        size = np.ones(len(symbols), np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        place = np.arange(len(symbols))
        # piece[i]: what symbols i and i+1 make; kept from round to round, renewed beside merges only
        piece = np.full(len(symbols), -1, np.int32)
        same = np.flatnonzero((word[1:] == word[:-1]) & (symbols[1:] >= 0) & (symbols[:-1] >= 0))
        piece[same] = self.pairs(symbols[same], symbols[same + 1])
        while len(symbols):
            rank = np.where(piece >= 0, self.rank_of[piece], NONE)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(word)))
            ended = best == NONE
            if ended.any():  # words without a pair leave
                gone = np.repeat(ended, length)
                done.append((place[gone], symbols[gone], word[gone], size[gone]))
                stay = ~gone
                symbols, word, size, place, piece, rank = (x[stay] for x in (symbols, word, size, place, piece, rank))
                best, length = best[~ended], length[~ended]
                if not len(symbols):
                    break
            chosen = np.flatnonzero(rank == np.repeat(best, length))
            # overlapping pairs of a run: every second one from the left
            apart = np.concatenate([[True], np.diff(chosen) > 1])
            run = np.maximum.accumulate(np.where(apart, np.arange(len(chosen)), 0))
            keep = (np.arange(len(chosen)) - run) % 2 == 0
            leftmost = np.concatenate([[True], word[chosen[1:]] != word[chosen[:-1]]])
            keep &= leftmost | ~self.careful[piece[chosen]]
            careful_word = np.unique(word[chosen[self.careful[piece[chosen]]]])
            if len(careful_word):
                keep &= leftmost | ~np.isin(word[chosen], careful_word)
            chosen = chosen[keep]
            symbols[chosen] = piece[chosen]
            size[chosen] += size[chosen + 1]
            stay = np.ones(len(symbols), bool)
            stay[chosen + 1] = False
            shift = np.cumsum(stay) - 1
            symbols, word, size, place, piece = (x[stay] for x in (symbols, word, size, place, piece))
            touched = shift[chosen]
            touched = np.unique(np.concatenate([touched, touched - 1]))
            touched = touched[touched >= 0]
            piece[touched] = -1
            inner = touched[touched < len(symbols) - 1]
            inner = inner[(word[inner] == word[inner + 1]) & (symbols[inner] >= 0) & (symbols[inner + 1] >= 0)]
            piece[inner] = self.pairs(symbols[inner], symbols[inner + 1])
        if not done:
            return symbols, word, size
        place, symbols, word, size = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(place)
        return symbols[order], word[order], size[order]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of distinct words, and the number of ids of each."""
        joined = "".join(words)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        symbols, word, size = self.merge(self.symbol[points], word)
        unknown = symbols < 0
        if not unknown.any():
            return symbols, np.bincount(word, minlength=len(words))
        # characters without a symbol become their bytes; they are never merged
        at = (np.cumsum(size) - size)[unknown]
        spelled = [joined[i].encode() for i in at.tolist()]
        count = np.ones(len(symbols), np.int64)
        count[unknown] = np.fromiter(map(len, spelled), np.int64, len(spelled))
        ids = np.repeat(symbols, count)
        ids[np.repeat(unknown, count)] = self.byte_id[np.frombuffer(b"".join(spelled), np.uint8)]
        return ids, np.bincount(word, count, len(words)).astype(np.int64)


_WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


class Codec:
    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.split = _WORD if self.pieces.symbol[10] < 0 else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.memo = Memo(self.pieces.encode_words)

    def encode(self, texts: list[str], end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts and the number of ids of each; an empty text has the end id only."""
        found = [self.split.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        ids, size = self.memo.lookup([w for words in found for w in words])
        of = np.repeat(np.arange(len(texts)), np.fromiter(map(len, found), np.int64, len(found)))
        count = np.bincount(of, size, len(texts)).astype(np.int64)
        if end:
            ids = np.insert(ids, np.cumsum(count), self.pieces.end)
            count += 1
        return ids, count

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``: bytes joined, control ids left out, the space of the first word dropped."""
        kinds = self.pieces.kinds
        control = (kinds[ids] == 2) & (ids != self.pieces.unknown)
        shown = np.flatnonzero(~control)
        if not len(shown):
            return ""
        ids = ids[shown[0]:shown[-1] + 1]
        parts = [self.pieces.text[i] for i in ids.tolist()]
        if kinds[ids[0]] == 0 and parts[0][:1] == b" ":
            parts[0] = parts[0][1:]
        if len(shown) == len(ids):
            try:
                return b"".join(parts).decode()
            except UnicodeDecodeError:
                pass
        out, run = [], b""  # bytes that are no text, or a control id between bytes
        for part, is_byte in zip(parts, (kinds[ids] == 1).tolist()):
            if is_byte:
                run += part
            else:
                out += [repaired(run), part.decode()]
                run = b""
        return "".join([*out, repaired(run)])


def repaired(data: bytes) -> str:
    """Text of bytes, each byte that belongs to no character replaced by U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at:at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_ready: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _ready:
        _ready[path] = Codec(path)
    return _ready[path]


def ids_of(column: pa.Array, path: str, end: bool) -> pa.ListArray:
    ready = codec(path)
    flat, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for run in slices([t or "" for t in column.to_pylist()]):
        got, count = ready.encode(run, end)
        flat.append(got.astype(np.int32))
        counts.append(count)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(flat)))


def texts_of(column: pa.ListArray, path: str) -> pa.Array:
    ready, flat = codec(path), column.flatten().to_numpy(zero_copy_only=False)
    out, at = [], 0
    for n in column.value_lengths().to_pylist():
        out.append(None if n is None else ready.decode(flat[at:at + n]))
        at += n or 0
    return pa.array(out, pa.string())


def encode(df: DataFrame, path: str, text: str = "text", to: str = "ids", end: bool = True) -> DataFrame:
    """``df`` with the column ``to``: ids of the whole text, with the end id. Null counts as empty. No shuffle.

    An existing column ``to`` is replaced. ``path`` names the model file on every machine.
    """
    importable(df)

    @F.arrow_udf("array<int>")
    def ids(column: pa.Array) -> pa.Array:
        return ids_of(column, path, end)

    return df.withColumn(to, ids(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with the column ``to``: the text of an array of ids, null for null. No shuffle."""
    importable(df)

    @F.arrow_udf("string")
    def texts(column: pa.Array) -> pa.Array:
        return texts_of(column, path)

    return df.withColumn(to, texts(F.col(ids)))


def encode_and_decode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded",
                      end: bool = True) -> DataFrame:
    """``df`` with both columns, as ``decode(encode(df))`` gives them, but each text encoded once."""
    importable(df)

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(column: pa.Array) -> pa.Array:
        found = ids_of(column, path, end)
        return pa.StructArray.from_arrays([found, texts_of(found, path)], ["ids", "decoded"])

    out = df.withColumn("_both", both(F.col(text)))
    return out.withColumns({ids: F.col("_both.ids"), decoded: F.col("_both.decoded")}).drop("_both")
