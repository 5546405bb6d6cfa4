"""SentencePiece encoding and decoding: Viterbi over a trie of the distinct marked words.

A marked word is a space mark and what follows up to the next space; no piece reaches beyond one. The distinct words of
a batch, sorted, are a trie walked depth-first: forward scores stay on a stack, and a word starts where it leaves the
prefix that it shares with the word before. In a unigram model a score is the best sum of log probabilities. In a BPE
model a path has the score 0 if each two neighbouring pieces are what merging by rank makes of their text, else minus
infinity; exactly one path ending at each place has 0, and it is the merge result (each part of a merged text is merged
like that part alone, and a sequence in which all neighbours agree is the merge result as a whole).
"""

from __future__ import annotations

import heapq
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, arrow_bytes, bounded_batches, in_slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words and pairs of pieces whose result a worker remembers.
MEMO = 600_000


def _fields(raw: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, raw[at : at + size]
            at += size


class Model:
    """Pieces, scores and kinds of a model file, and encoding and decoding of texts with it."""

    def __init__(self, raw: bytes) -> None:
        self.pieces, self.scores, self.kinds = [], [], []
        self.bpe, prefix, extra, name = False, True, True, ""
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode("utf-8"))
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                spec = dict(_fields(value))
                name, prefix, extra = spec.get(1, b"").decode(), spec.get(3, 1), spec.get(4, 1)
        if name not in ("identity", "") or not prefix or extra:
            raise ValueError("only models that keep texts as they are and begin them with a space mark are read")
        self._set_up()

    def _set_up(self) -> None:
        self.id = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, USER)}
        if any(MARK in p.lstrip(MARK) or (p.startswith(MARK * 2) and p.strip(MARK)) for p in self.id):
            raise ValueError("a piece reaches over a space")
        if MARK not in self.id:
            raise ValueError("the space mark is no piece")
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.trie: list = [{}, -1]
        for p, i in self.id.items():
            node = self.trie
            for char in p:
                node = node[0].setdefault(char, [{}, -1])
            node[1] = i
        self.least = min((self.scores[i] for i in self.id.values()), default=0.0) - 10
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds)]
        self.words: dict[bytes, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.runs: dict[int, bytes] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in ("pieces", "scores", "kinds", "bpe")}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self._set_up()

    # ---- merging, for pairs of pieces and runs of marks ----

    def merged(self, text: str) -> list[str]:
        """What merging by score makes of a text: the best pair first, the leftmost of equals."""
        part = list(text)
        left, right = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := self.id.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (-self.scores[i], a, b, part[a] + part[b]))

        for a in range(len(part) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, whole = heapq.heappop(heap)
            if right[a] != b or not part[a] or part[a] + part[b] != whole:
                continue
            part[a], part[b], right[a] = whole, "", right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in part if p]

    def _agree(self, before: int, piece: int) -> bool:
        """Whether merging keeps the two apart and whole. before: -1 at a text's start or after an unknown character."""
        a, b = (self.pieces[before] if before >= 0 else ""), self.pieces[piece]
        if len(self.pairs) > MEMO:
            self.pairs.clear()
        known = self.pairs[before * len(self.pieces) + piece] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    # ---- the trie of words ----

    def _unknown_ids(self, char: str) -> list[int]:
        raw = char.encode("utf-8", "surrogatepass")
        return [self.byte[b] for b in raw] if len(self.byte) == 256 else [self.unknown]

    def paths(self, words: list[str]):
        """The ids of each of some sorted texts.

        Per place in the current text there are: the pieces begun before it that may go on (their start and their node
        in the vocabulary's trie), the score, and start and id of the best piece that ends there. All of it stays for
        the prefix that a text shares with the next one.
        """
        root, bpe, scores, size = self.trie, self.bpe, self.scores, len(self.pieces)
        pairs, agree = self.pairs, self._agree
        begun, score, start, piece, before = [[]], [0.0], [0], [-1], ""
        for w in words:
            shared = 0
            for x, y in zip(w, before):
                if x != y:
                    break
                shared += 1
            del begun[shared + 1 :], score[shared + 1 :], start[shared + 1 :], piece[shared + 1 :]
            for end in range(shared, len(w)):
                char, going = w[end], []
                best, come, own = -np.inf, end, -1
                for j, node in (*begun[end], (end, root)):
                    child = node[0].get(char)
                    if child is None:
                        continue
                    going.append((j, child))
                    i = child[1]
                    if i < 0:
                        continue
                    if bpe:
                        if best < 0:
                            known = pairs.get(piece[j] * size + i)
                            if known or (known is None and agree(piece[j], i)):
                                best, come, own = 0.0, j, i
                    elif score[j] + scores[i] > best:
                        best, come, own = score[j] + scores[i], j, i
                if own < 0:  # a character that is no piece (each that is one has a path)
                    best = score[end] + (0.0 if bpe else self.least)
                begun.append(going)
                score.append(best)
                start.append(come)
                piece.append(own)
            before, at, out = w, len(w), []
            while at:
                if piece[at] >= 0:
                    out.append(piece[at])
                else:
                    out += self._unknown_ids(w[at - 1])[::-1]
                at = start[at]
            yield out[::-1]

    def learn(self, words: set[bytes]) -> None:
        """Encodes the words that are not known yet, each with one mark before it."""
        if len(self.words) + len(words) > MEMO:
            self.words.clear()
        texts = sorted(w.decode("utf-8", "surrogatepass") for w in words if w not in self.words)
        for w, ids in zip(texts, self.paths([MARK + w for w in texts])):
            self.words[w.encode("utf-8", "surrogatepass")] = np.array(ids, np.int32).tobytes()

    def _run(self, n: int) -> bytes:
        """Ids of n marks that no word takes."""
        if n not in self.runs:
            if len(self.runs) > 10_000:
                self.runs.clear()
            ids = [self.id[p] for p in self.merged(MARK * n)] if self.bpe else next(self.paths([MARK * n]))
            self.runs[n] = np.array(ids, np.int32).tobytes()
        return self.runs[n]

    def _spaced(self, words: list[bytes]) -> bytes:
        """Ids of a text with runs of spaces: an empty word is a further mark before the next."""
        out, marks = [], 0
        bare = np.array([self.id[MARK]], np.int32).tobytes()
        for w in words:
            marks += 1
            if w:
                ids = self.words[w]
                if marks > 1:
                    alone = ids.startswith(bare) and len(bare) < len(ids)
                    ids = self._run(marks) + ids[len(bare) :] if alone else self._run(marks - 1) + ids
                out.append(ids)
                marks = 0
        return b"".join([*out, self._run(marks)] if marks else out)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text (UTF-8). A literal space mark in a text counts as a space."""
        mark = MARK.encode()
        split = [t.replace(mark, b" ").split(b" ") if t else [] for t in texts]
        new = set().union(*split) if split else set()
        new.discard(b"")
        self.learn(new)
        if len(new) > MEMO // 2:  # more words than are remembered: text by text
            out = []
            for ws in split:
                self.learn(set(ws) - {b""})
                out.append(self._spaced(ws))
        else:
            known = self.words.__getitem__
            out = [self._spaced(ws) if b"" in ws else b"".join(map(known, ws)) for ws in split]
        return [np.frombuffer(x, np.int32) for x in out]

    def decode(self, ids) -> bytes:
        """The text (UTF-8) of ids; the mark that encoding puts first goes."""
        text = b"".join(map(self.raw.__getitem__, ids))
        return text[1:] if text.startswith(b" ") else text


def read_model(path: str) -> Model:
    """A model from a file that the driver can open; executors get it by broadcast."""
    with open(path, "rb") as f:
        return Model(f.read())


def encode(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", check: bool = False) -> DataFrame:
    """(key, ids), and with check also same: whether decoding the ids gives the text again.

    Null text: null ids (and null same). Empty text: no ids. A text that holds the mark U+2581 itself comes back with a
    space there. Repeated rows and null keys are rows like others. Empty table: no rows. Further columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            raw = b.column(1)
            data, offsets = arrow_bytes(raw)
            ids, same = [], []
            for lo, hi in in_slices(np.diff(offsets).tolist(), SLICE):
                texts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(lo, hi)]
                own = shared.value.encode(texts)
                ids += own
                if check:
                    same += [shared.value.decode(i.tolist()) == t for i, t in zip(own, texts)]
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            at = np.r_[0, np.cumsum([len(i) for i in ids])].astype(np.int32)
            null = np.asarray(raw.is_null())
            lists = pa.ListArray.from_arrays(pa.array(at, mask=np.r_[null, False]) if null.any() else pa.array(at), pa.array(flat))
            cols = [b.column(0), lists] + ([pa.array(np.array(same, bool), mask=null)] if check else [])
            yield pa.RecordBatch.from_arrays(cols, names=[key, "ids", "same"][: len(cols)])

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>" + (", same boolean" if check else "")
    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: Model, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of ids. Null ids: null text; ids outside the vocabulary or null count as unknown."""
    spark = encoded.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        n = len(m.pieces)
        for b in batches:
            texts = [
                None if x is None else m.decode([i if i is not None and 0 <= i < n else m.unknown for i in x]).decode("utf-8", "replace") for x in b.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(F.col(key), F.col(ids).alias("_ids")).mapInArrow(run, f"`{key}` {encoded.schema[key].dataType.simpleString()}, text string")
