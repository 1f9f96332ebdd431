"""SentencePiece encoding and decoding as weighted finite-state transduction.

Three machines are compiled from a model file: the normaliser (a mark before the text, spaces to marks), the piece
machine (a path for each piece) and the byte fallback (byte pieces for each other character). `PieceMachine.transducer`
composes them; the shortest path of an input through the composition, in the tropical semiring, is its encoding. For
unigram models an arc weighs minus the piece's score. For BPE models the weights are 0 and infinity: the state
remembers the piece before, and a piece may follow only if merging the two spelt together ends in just these two. A
sequence of pieces is the merge result exactly if every neighbouring pair in it is, so one path of finite weight is left.

`encode` takes the same shortest path without building the composition: normalised text is cut where no piece goes on
(before a mark, and between classes of characters that no piece mixes), as there the path falls into independent
parts; a part's path is found over its positions, and each worker keeps the paths of parts that it has seen, in a
memory of bounded size. The tests hold it against the composed machines and against the public library. Two things
leave the machines. Runs of marks, whose pieces all tie in score, take the merges themselves, leftmost first. And
models whose normaliser rewrites other characters are refused.

Decoding runs the machines backwards: pieces to text, runs of byte pieces to UTF-8, marks to spaces.

Cases: a null text has null ids; an empty text has none; a text that holds the word mark itself decodes to spaces,
so it doesn't round-trip, and neither do lone surrogates; repeated rows are encoded each on its own; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import importlib
import math
import os
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table
from .transducer import Arc, Machine, compose

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Pairs of pieces whose arcs a worker keeps, and parts whose paths it keeps, twice at most.
PAIRS = 500_000
CACHED = 200_000
#: A model file: a path, or the name of one of the public tokenizer files that come with the machine.
MODEL = "piece_bpe_32k.model"


def model_path(model: str = MODEL) -> str:
    """A path as it is; a name where the machine's module of public tokenizer files has it."""
    if os.sep in model:
        return model
    try:
        return importlib.import_module("public_tokenizers").path(model)
    except ImportError as e:
        raise FileNotFoundError(f"{model}: give the path of a model file, as this machine has no public tokenizer files") from e


class Paths(dict):
    """Paths of parts that were seen. When full, what is still in use moves over from the older half."""

    def __init__(self, find: Callable[[str], tuple[int, ...]], older: dict | None = None):
        super().__init__()
        self.find, self.older = find, older or {}

    def __missing__(self, part: str) -> tuple[int, ...]:
        ids = self.older.get(part) or self.find(part)
        if len(part) < 64:
            self[part] = ids
        return ids


class PieceMachine:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kind = model.normalizer_spec, model.trainer_spec.model_type
        if kind not in (UNIGRAM, BPE) or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only unigram and BPE models with an identity normaliser are compiled")
        self.dummy, self.bpe = spec.add_dummy_prefix, kind == BPE
        self.pieces = [p.piece for p in model.pieces]
        self.score = [p.score for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.silent = {i for i, p in enumerate(model.pieces) if p.type in (CONTROL, UNUSED)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.longest = max(map(len, self.ids))
        #: What pieces begin with: where a text leaves this set, no longer piece fits.
        self.heads = {p[:k]: -1 for p in self.ids for k in range(1, len(p) + 1)} | self.ids
        self.pairs: defaultdict[int, dict[int, bool]] = defaultdict(dict)
        self.known = 0
        self.spines: dict[tuple[int, int], list[tuple[str, float, float]]] = {}
        self.cache = Paths(self.path)
        self.parts = re.compile(self._part_pattern())

    def _part_pattern(self) -> str:
        """Splits only where no piece goes on: before a mark, and between letters and others if pieces never mix them."""
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            return r"(?s).+"
        bodies = [p.lstrip(MARK) for p in self.ids]
        mixed = any(len({c.isalpha() for c in b}) > 1 for b in bodies)
        letter = r"[^\W\d_]"
        if mixed or any(re.fullmatch(letter, c) is None for b in bodies for c in b if c.isalpha()):
            return rf"{MARK}*[^{MARK}]+|{MARK}+"
        return rf"{MARK}*{letter}+|{MARK}*(?:(?!{letter})[^{MARK}])+|{MARK}+"

    def encode(self, text: str) -> list[int]:
        """Ids of the pieces of the shortest path."""
        if not text:
            return []
        line = (MARK if self.dummy else "") + text.replace(" ", MARK)
        if len(self.cache) > CACHED:
            self.cache = Paths(self.path, dict(self.cache))
        return list(chain.from_iterable(map(self.cache.__getitem__, self.parts.findall(line))))

    def normaliser(self) -> Machine:
        """Writes a mark first, if the model wants it, and a mark for each space."""
        marked = lambda state: [((MARK,), 0.0, True)] if not state else []
        return Machine(not self.dummy, lambda state, c: [((MARK if c == " " else c,), 0.0, True)] if state else [], marked, bool)

    def piece_machine(self) -> Machine:
        """Spells pieces, by their heads, and writes their ids; what is no piece by itself falls back to bytes. A state is a head and the piece before."""
        worst = 10 - min((self.score[i] for i in self.ids.values()), default=0.0)
        heads = {p[:k] for p in self.ids for k in range(len(p) + 1)}

        def read(state: tuple[str, int], c: str) -> list[Arc]:
            head, before = state
            out: list[Arc] = [((), 0.0, (head + c, before))] if head + c in heads else []
            if not head and c not in self.ids:
                out.append((self.fallback(c), 0.0 if self.bpe else worst, ("", -1)))
            return out

        def silent(state: tuple[str, int]) -> list[Arc]:
            head, before = state
            piece = self.ids.get(head) if head else None
            if piece is None or (self.bpe and not self.may_follow(before, piece)):
                return []
            return [((piece,), 0.0 if self.bpe else -self.score[piece], ("", piece if self.bpe else -1))]

        return Machine(("", -1), read, silent, lambda state: not state[0])

    def transducer(self) -> Machine:
        """The composition of all three."""
        return compose(self.normaliser(), self.piece_machine())

    def may_follow(self, a: int, b: int) -> bool:
        held = self.pairs[a].get(b)
        return self.follows(a, b) if held is None else held

    def path(self, part: str) -> tuple[int, ...]:
        if self.bpe:
            run = len(part) - len(part.lstrip(MARK))
            if run > 1:
                return self.marked(part, run)
            return self.merged_path(part)
        return self.best_path(part)

    def fallback(self, c: str) -> tuple[int, ...]:
        if not self.bytes:
            return (self.unknown,)
        return tuple(self.bytes[b] for b in c.encode("utf-8", "replace"))

    def merged_path(self, part: str) -> tuple[int, ...]:
        """The only path of finite weight. last[e] is the piece before position e, as each prefix has one path too."""
        n, heads = len(part), self.heads.get
        last: list[int | None] = [None] * (n + 1)
        begin = [0] * (n + 1)
        last[0] = -1
        for s in range(n):
            before = last[s]
            arcs = self.pairs[before]
            for e in range(s + 1, n + 1):
                piece = heads(part[s:e])
                if piece is None:
                    break
                if piece >= 0 and last[e] is None:
                    fits = arcs.get(piece)
                    if fits or (fits is None and self.follows(before, piece)):
                        last[e], begin[e] = piece, s
            if last[s + 1] is None:
                last[s + 1], begin[s + 1] = -1, s  # byte fallback: no merge reaches across it
        out: list[tuple[int, ...]] = []
        e = n
        while e:
            out.append(self.fallback(part[begin[e] : e]) if last[e] == -1 else (last[e],))
            e = begin[e]
        return tuple(i for ids_ in reversed(out) for i in ids_)

    def stands(self, piece: int) -> bool:
        """Whether merging a piece's characters ends in the piece itself."""
        return self.merged(self.pieces[piece]) == [self.pieces[piece]]

    def follows(self, a: int, b: int) -> bool:
        """The pair machine's arc from piece a (-1: the beginning, or byte fallback) to piece b."""
        if self.known > PAIRS:
            self.pairs.clear()
            self.known = 0
        self.known += 1
        self.pairs[a][b] = fits = self.stands(b) if a == -1 else self._apart(a, b)
        return fits

    def _apart(self, a: int, b: int) -> bool:
        """Whether no merge goes across the border of two pieces.

        The last part of a and the first part of b change as merges go on, each from its making to the merge that
        uses it up. A merge of both happens if it is better than those. That holds if merges get worse on the way,
        as in all trained pieces; for others, the merges are made.
        """
        ends, begins = self.spine(a, -1), self.spine(b, 0)
        ids, score = self.ids, self.score
        if ends and begins:
            for x, made, used in ends:
                for y, made_y, used_y in begins:
                    k = ids.get(x + y)
                    if k is not None:
                        if score[k] > min(made, made_y):
                            break
                        if score[k] > used and score[k] >= used_y:
                            return False
                else:
                    continue
                break
            else:
                return True
        x, y = self.pieces[a], self.pieces[b]
        return self.merged(x + y) == [x, y]

    def spine(self, piece: int, side: int) -> list[tuple[str, float, float]]:
        """The parts at one end (0 or -1) of a piece, from the whole to the character: (text, score when made, score when used up).

        Empty if the piece doesn't stand, or if a merge on the way is better than one before it.
        """
        key = (piece, side)
        if key in self.spines:
            return self.spines[key]
        out: list[tuple[str, float, float]] = []
        node, used = self.merge_tree(self.pieces[piece]), -math.inf
        regular = node is not None
        while regular:
            text, parts = node
            made = self.score[self.ids[text]] if parts else math.inf
            out.append((text, made, used))
            if not parts:
                break
            regular = made > used and all(not below or self.score[self.ids[t]] >= made for t, below in parts)
            node, used = parts[side], made
        self.spines[key] = out if regular else []
        return self.spines[key]

    def merge_tree(self, text: str) -> tuple | None:
        """(text, its two parts) of a string that merges into one piece; a character has no parts."""
        nodes: list[tuple] = [(c, ()) for c in text]
        while len(nodes) > 1:
            best, at = -math.inf, -1
            for i in range(len(nodes) - 1):
                k = self.ids.get(nodes[i][0] + nodes[i + 1][0])
                if k is not None and self.score[k] > best:
                    best, at = self.score[k], i
            if at < 0:
                return None
            nodes[at : at + 2] = [(nodes[at][0] + nodes[at + 1][0], (nodes[at], nodes[at + 1]))]
        return nodes[0]

    def merged(self, text: str) -> list[str]:
        """Merges of a short string: always the best-scored neighbouring pair, the leftmost of equals."""
        parts, ids, score = list(text), self.ids, self.score
        while len(parts) > 1:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and score[k] > best:
                    best, at = score[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def marked(self, part: str, run: int) -> tuple[int, ...]:
        """A part that begins with several marks: its tied pieces take the merges themselves."""
        rest = part[run:]
        head = self.merged_path(MARK + rest) if rest else ()
        joined = bool(rest) and self.pieces[head[0]] != MARK
        marks = run - 1 if joined else run
        out: list[int] = []
        for block in self.merged_marks(marks):
            out.append(self.ids[block])
        return (*out, *(head if joined else head[1:] if rest else ()))

    def merged_marks(self, n: int) -> list[str]:
        """Leftmost merges of n marks, in time linear in n: a piece joins the one before it, else takes the next mark."""
        out: list[int] = []
        left = n
        while left:
            size, left = 1, left - 1
            while True:
                if out and MARK * (out[-1] + size) in self.ids:
                    size += out.pop()
                elif left and MARK * (size + 1) in self.ids:
                    size, left = size + 1, left - 1
                else:
                    break
            out.append(size)
        return [MARK * size for size in out]

    def best_path(self, part: str) -> tuple[int, ...]:
        """Unigram models: the path of least weight; an unknown character weighs 10 more than the worst piece."""
        n, ids, score = len(part), self.ids, self.score
        worst = 10 - min(score[i] for i in ids.values())
        weight, back = [0.0] + [math.inf] * n, [(0, ())] * (n + 1)
        for s in range(n):
            for e in range(s + 1, min(n, s + self.longest) + 1):
                k = ids.get(part[s:e])
                w = weight[s] + (-score[k] if k is not None else worst)
                if (k is not None or e == s + 1) and w < weight[e]:
                    weight[e], back[e] = w, (s, (k,) if k is not None else self.fallback(part[s:e]))
        out, e = [], n
        while e:
            out.append(back[e][1])
            e = back[e][0]
        return tuple(i for ids_ in reversed(out) for i in ids_)

    def decode(self, ids: list[int]) -> str:
        pieces, byte_of = self.pieces, self.byte_of
        if byte_of.keys().isdisjoint(ids) and self.silent.isdisjoint(ids):
            line = "".join([pieces[i] for i in ids])
        else:
            out, held = [], bytearray()
            for i in ids:
                if i in byte_of:
                    held.append(byte_of[i])
                    continue
                if held:
                    out.append(held.decode("utf-8", "replace"))
                    held.clear()
                if i not in self.silent:
                    out.append(pieces[i])
            line = "".join(out) + held.decode("utf-8", "replace")
        line = line.replace(MARK, " ")
        return line[1:] if self.dummy and line[:1] == " " else line


_machines: dict[str, PieceMachine] = {}


def machine(name: str) -> PieceMachine:
    """The machine of a model, compiled once in each worker."""
    if name not in _machines:
        _machines[name] = PieceMachine(model_path(name))
    return _machines[name]


#: Texts whose ids a task holds at a time.
SLICE = 128


def encoder(name: str = MODEL):
    """A function over Arrow batches of a key and a text: key, number of pieces, ids, whether they decode to the text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(name)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = part.column(1).to_pylist()
                packed, same = [], []
                for text in texts:
                    ids = m.encode(text or "")
                    same.append(None if text is None else m.decode(ids) == text)
                    packed.append(np.array(ids, np.int32))
                sizes = np.array([len(x) for x in packed], np.int64)
                none = np.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(np.concatenate(packed)), mask=pa.array(none))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, mask=none), lists, pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids", "round_trip"])

    return encode


def decoder(name: str = MODEL):
    """An Arrow-batched function from ids to texts."""

    def decode(ids: pd.Series) -> pd.Series:
        m = machine(name)
        return pd.Series([None if x is None else m.decode([int(i) for i in x]) for x in ids])

    return F.pandas_udf(decode, "string")


def encode_pieces(docs: DataFrame, *, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids, round_trip (whether decoding the ids gives the text back)."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pieces long, ids array<int>, round_trip boolean"
    return docs.select("doc_id", "text").mapInArrow(encoder(model), schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"))
