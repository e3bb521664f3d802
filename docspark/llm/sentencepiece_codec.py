"""SentencePiece encoding and decoding by a shared-prefix forward pass over distinct marked words.

A text's spaces become the mark U+2581 and it falls into words: a text is cut wherever no piece
of the model holds the two characters beside each other. So a word has its marks before it, and
letters, digits and punctuation are mostly words of their own. No piece crosses a cut, hence words
are encoded one by one. The distinct words of a batch are sorted, which lays them out as a trie in
depth-first order, and one stack of forward states is kept: going from a word to the next drops the
states beyond their common prefix and goes on from there.

For a unigram model the state of a prefix is its best score and last piece (Viterbi). For a
BPE model scores are merge ranks, and the best sum of ranks isn't the segmentation that merging gives.
There the state is the last piece of the prefix's own encoding. It is the one piece
that is stable beside the last piece of the rest: merging the two
texts gives the two pieces back. This gives the same ids as merging, and shares prefixes too.
With one more character the last piece is that character or mostly a suffix of the one before
and it; what these may be is remembered, and longer suffixes are tried only if none of them fits.

Texts stay where they are: no shuffle, and memory is bounded by a batch and the word cache.

Defined results: null and empty texts have no tokens and decode to an empty text; characters
that the model lacks become byte pieces (or the unknown piece, runs of it merged, in a model
without bytes); a text with U+2581 itself decodes to a space there; ties in a unigram model go to the
longer last piece; repeated rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import process_cache

MARK = "▁"
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Kinds of pieces and of models, as the format numbers them.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield number, data[at : at + size]
            at += size


class Codec:
    """Encoder and decoder of one model."""

    #: Words whose ids are remembered.
    most_words = 300_000
    most_pairs = 400_000

    def __init__(self, model: bytes):
        self.kind, self.bytes_too, self.prefix, charsmap, squeeze = UNIGRAM, False, True, b"", True
        self.text_of, self.score, kinds = [], [], []
        for number, value in _fields(model):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.text_of.append(piece)
                self.score.append(score)
                kinds.append(kind)
            elif number == 2:
                spec = dict(_fields(value))
                self.kind, self.bytes_too = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(_fields(value))
                charsmap, self.prefix, squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.normalizer = None
        if charsmap or squeeze:
            import sentencepiece

            self.normalizer = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.text_of, kinds)) if k in (NORMAL, USER_DEFINED)}
        self.unknown = kinds.index(UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.text_of, kinds)) if k == BYTE}
        self.size = [len(p) for p in self.text_of]
        self.longest = max(map(len, self.ids))
        back = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.raw = [back.get(i, b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode()) for i, (p, k) in enumerate(zip(self.text_of, kinds))]
        self.units = re.compile(self._pattern()).findall
        self.packed = [struct.pack("=i", i) for i in range(len(self.text_of))]
        self.pieces = pa.array(self.raw, pa.large_binary())
        self.words: dict[str, bytes] = {}  # 32-bit ids
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.steps: list[dict[str, int | tuple]] = [{} for _ in self.text_of]
        self.n_steps = 0

    def _pattern(self) -> str:
        """Words: marks before a run of characters that some chain of pieces holds side by side."""
        inner = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)  # marks end or part pieces, too
        group = {p: p for p in self.ids if len(p) == 1 and (inner or p != MARK)}

        def find(char):
            while group[char] != char:
                group[char] = char = group[group[char]]
            return char

        beside = set()  # characters that some piece holds beside another one
        for piece in self.ids:
            for a, b in zip(piece, piece[1:]):
                if a in group and b in group:
                    group[find(a)] = find(b)
                    beside |= {a, b}
        runs, single = {}, "".join(re.escape(c) for c in group if c not in beside)
        for c in sorted(beside):
            runs.setdefault(find(c), []).append(re.escape(c))
        parts = [f"[{''.join(r)}]+" for r in sorted(runs.values(), key=len, reverse=True)] + ([f"[{single}]"] if single else [])
        words = [f"(?:{'|'.join(parts)})" if inner else f"{MARK}*(?:{'|'.join(parts)})"] if parts else []
        return "|".join([*words, *([] if inner else [f"{MARK}+"]), "(?s:.)"])

    def merged(self, text: str) -> list[int]:
        """BPE by merging: the best-ranked pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = at = None
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.score[piece] > best):
                    best, at = self.score[piece], i
            if at is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def stable(self, a: int, b: int) -> bool:
        key = a << 24 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.text_of[a] + self.text_of[b]) == [a, b]
        return known

    def whole(self, a: int) -> bool:
        known = self.alone.get(a)
        if known is None:
            known = self.alone[a] = self.merged(self.text_of[a]) == [a]
        return known

    def last_piece(self, unit: str, end: int, states: list[int]) -> int:
        get, pairs = self.ids.get, self.pairs.get
        # short pieces are the likelier ones; only one fits, so the order doesn't matter otherwise
        for start in range(end - 1, max(-1, end - self.longest - 1), -1):
            piece = get(unit[start:end])
            if piece is None:
                continue
            if start:
                # a pair that merging leaves as it is has two pieces that merging makes
                ok = pairs(states[start] << 24 | piece)
                if ok or ok is None and self.stable(states[start], piece):
                    return piece
            elif self.whole(piece):
                return piece
        raise AssertionError("every prefix has an encoding")

    def step(self, last: int, char: str) -> int | tuple[tuple[int, int], ...]:
        """The last piece after ``last`` and a character: the character, or else (size, piece) of longer suffixes of both."""
        if self.n_steps >= self.most_pairs:
            for row in self.steps:
                row.clear()
            self.n_steps = 0
        alone, text = self.ids[char], self.text_of[last] + char
        if self.stable(last, alone):
            found = alone
        else:
            found = tuple((n, self.ids[text[-n:]]) for n in range(2, len(text) + 1) if text[-n:] in self.ids)
        self.steps[last][char] = found
        self.n_steps += 1
        return found

    def last_pieces(self, unit: str, states: list[int]) -> None:
        """Bring ``states``, those of a prefix, to the whole unit."""
        steps, pairs = self.steps, self.pairs.get
        if len(states) == 1:
            states.append(self.ids[unit[0]])
        last = states[-1]
        for end in range(len(states), len(unit) + 1):
            char = unit[end - 1]
            found = steps[last].get(char)
            if found is None:
                found = self.step(last, char)
            if found.__class__ is int:
                last = found
            else:
                for n, piece in found:
                    if n == end:
                        ok = self.whole(piece)
                    else:
                        ok = pairs(states[end - n] << 24 | piece)
                        if ok is None:
                            ok = self.stable(states[end - n], piece)
                    if ok:
                        last = piece
                        break
                else:
                    last = self.last_piece(unit, end, states)
            states.append(last)

    def best_piece(self, unit: str, end: int, states: list[int], scores: list[float]) -> int:
        best, choice = -np.inf, -1
        for start in range(max(0, end - self.longest), end):
            piece = self.ids.get(unit[start:end])
            if piece is not None and scores[start] + self.score[piece] > best:
                best, choice = scores[start] + self.score[piece], piece
        scores.append(best)
        return choice

    def encode_units(self, units) -> None:
        """Remember the ids of each distinct unit of known characters."""
        out, before, states, scores = self.words, "", [-1], [0.0]
        size, packed = self.size, self.packed
        for unit in sorted(units):
            same = 0
            for x, y in zip(before, unit):
                if x != y:
                    break
                same += 1
            del states[same + 1 :], scores[same + 1 :]
            if self.kind == BPE:
                self.last_pieces(unit, states)
            else:
                for end in range(same + 1, len(unit) + 1):
                    states.append(self.best_piece(unit, end, states, scores))
            ids, end = [], len(unit)
            while end:
                piece = states[end]
                ids.append(packed[piece])
                end -= size[piece]
            ids.reverse()
            out[unit] = b"".join(ids)
            before = unit

    def _other(self, char: str) -> bytes:
        return array("i", [self.byte_ids[b] for b in char.encode()] if self.bytes_too else [self.unknown]).tobytes()

    def _learn(self, words: set[str]) -> None:
        """Encode words; a character that the model lacks is a word, too."""
        lacking = {w for w in words if len(w) == 1 and w not in self.ids}
        self.words.update((w, self._other(w)) for w in lacking)
        self.encode_units(words - lacking if lacking else words)

    def marked_words(self, text: str) -> list[str]:
        if self.normalizer:
            return self.units(self.normalizer.normalize(text))
        return self.units((MARK if self.prefix else "") + text.replace(" ", MARK)) if text else []

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; all new words of the batch go through one traversal."""
        words = [self.marked_words(t or "") for t in texts]
        new = set()
        for w in words:
            new.update(w)
        if len(self.words) > self.most_words:  # leave what this batch takes
            self.words = {w: self.words[w] for w in new if w in self.words}
        new.difference_update(self.words)
        self._learn(new)
        get, out = self.words.__getitem__, []
        for w in words:
            ids = np.frombuffer(b"".join(map(get, w)), np.int32)
            if not self.bytes_too and len(ids):
                ids = ids[np.concatenate([[True], (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)])]
            out.append(ids)
        return out

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text

    def decode_batch(self, flat: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of ids that lie one after the other."""
        raw = self.pieces.take(pa.array(flat))
        ends = np.frombuffer(raw.buffers()[1], np.int64)[offsets].tolist() if len(flat) else [0] * len(offsets)
        data = memoryview(raw.buffers()[2] or b"")
        texts = (str(data[a:b], "utf-8", "replace") for a, b in zip(ends, ends[1:]))
        return [t[1:] if self.prefix and t[:1] == " " else t for t in texts]


def encode(docs: DataFrame, *keep: str, model_file: str = MODEL_FILE) -> DataFrame:
    """``keep`` columns, token_ids, n_tokens, and round_trip: whether decoding gives the text back."""
    keep = keep or ("doc_id",)
    # the model file: its size doesn't depend on the corpus
    model = docs.sparkSession.sparkContext.broadcast(Path(model_file).read_bytes())
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)

    def run(batches):
        codec = process_cache(("sentencepiece", hash(model.value)), lambda: Codec(model.value))
        for big in batches:
            # traversals over a thousand texts hold few words at a time
            for b in (big.slice(i, 1000) for i in range(0, big.num_rows, 1000)):
                texts = [t or "" for t in b.column("_text").to_pylist()]
                ids = codec.encode_batch(texts)
                sizes = [len(x) for x in ids]
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int32)
                same = pa.array([x == t for x, t in zip(codec.decode_batch(flat, offsets), texts)], pa.bool_())
                cols = [*(b.column(k) for k in keep), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(sizes, pa.int32()), same]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "token_ids", "n_tokens", "round_trip"])
        codec.words.clear()  # the worker may serve other stages next

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, ddl + "token_ids array<int>, n_tokens int, round_trip boolean")


def decode(tokens: DataFrame, *keep: str, model_file: str = MODEL_FILE) -> DataFrame:
    """``keep`` columns and the text of token_ids."""
    keep = keep or ("doc_id",)
    model = tokens.sparkSession.sparkContext.broadcast(Path(model_file).read_bytes())
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in tokens.select(*keep).schema)

    def run(batches):
        codec = process_cache(("sentencepiece", hash(model.value)), lambda: Codec(model.value))
        for b in batches:
            texts = pa.array([codec.decode(x or ()) for x in b.column("_ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), texts], names=[*keep, "text"])

    return tokens.select(*keep, F.col("token_ids").alias("_ids")).mapInArrow(run, ddl + "text string")
