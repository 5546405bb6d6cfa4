"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field adds kinds that no fixed pattern holds: phone numbers without a country
code, national ids and secrets. It sees only shapes of words (digits, letter case, punctuation, length) of a word and
its two neighbours, is trained from a small labelled table and decoded by Viterbi over padded numpy batches. Its
sequences are the runs of words that hold a digit or one of a few signs, with up to two words on both sides.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, arrow_bytes, bounded_batches, in_slices, words_of

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("local_phone", "national_id", "secret")
KINDS = BASE_KINDS + ADDED_KINDS
SPAN = "struct<kind:string,start:int,end:int,base:boolean>"

# ---- base patterns, over UTF-8 bytes --------------------------------------------------------------------------------

_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match that begins inside a run of digits cannot succeed where one at the run's start failed
_IP = re.compile(rb"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(rb"[^0-9]+")


def _emails(b: bytes):
    """Around each @: what can stand before it, back to the last match; then the domain."""
    at, last = b.find(b"@"), 0
    while at >= 0:
        start = at
        while start > last and b[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(b, at + 1) if start < at else None
        if m:
            last = m.end()
            yield start, last
        at = b.find(b"@", max(at + 1, last))


def luhn(digits: bytes) -> bool:
    values = np.frombuffer(digits, np.uint8)[::-1].astype(int) - 48
    doubled = values[1::2] * 2
    return (values[::2].sum() + np.where(doubled > 9, doubled - 9, doubled).sum()) % 10 == 0


def base_spans(b: bytes) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) in bytes, sorted."""
    found = [(s, 0, e) for s, e in _emails(b)]
    for m in _IP.finditer(b):
        if all(len(p := g.lstrip(b"0")) <= 3 and int(p or b"0") <= 255 for g in m.groups()):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(b):
        digits = _NOT_DIGIT.sub(b"", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if b"+" in b:
        for m in _PHONE.finditer(b):
            if 9 <= len(_NOT_DIGIT.sub(b"", m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# ---- word shapes ----------------------------------------------------------------------------------------------------

#: Features of a shape, with the number of values of each.
SHAPE = {"digits": 8, "letters": 5, "hex": 2, "hyphens": 4, "paren": 2, "quote": 2, "equals": 3, "length": 4, "dot": 3, "at": 2, "plus": 2, "slash_colon": 2}
_SIZES = np.array(list(SHAPE.values()))
_FIRST = np.r_[0, np.cumsum(_SIZES)[:-1]]
N_FEATURES = int(_SIZES.sum())
_CLASSES = 12


def _class_table() -> np.ndarray:
    t = np.zeros((256, _CLASSES), np.int32)
    for i, chars in enumerate(
        (b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789abcdefABCDEF", b"-", b"()", b"\"'`", b"=", b".", b"@", b"+", b"/:")
    ):
        t[list(chars), i] = 1
    t[128:, 1] = 1  # letters beyond ASCII count as lower case
    return t


_TABLE = _class_table()
_SPECIAL = np.zeros(256, bool)
_SPECIAL[list(b"0123456789=\"@+_")] = True


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(words, features) indices into the feature weights."""
    n = ends - starts
    out = np.zeros((len(starts), len(SHAPE)), np.int64)
    if not len(starts):
        return out
    # bytes of these words only, one after the other
    first = np.r_[0, np.cumsum(n)[:-1]]
    at = np.arange(n.sum()) - np.repeat(first, n) + np.repeat(starts, n)
    c = np.add.reduceat(_TABLE[data[at]], first, axis=0)
    digit, lower, upper, hexa, hyphen, paren, quote, equal, dot, a, plus, slash = c.T
    letters = np.where(lower + upper == 0, 0, np.where(upper == 0, 1, np.where(lower == 0, 2, np.where((upper == 1) & (_TABLE[data[starts], 2] == 1), 3, 4))))
    out[:, 0] = np.searchsorted([1, 3, 4, 5, 7, 10, 16], digit, side="right")
    out[:, 1] = letters
    out[:, 2] = (hexa >= 16) & (hexa == digit + lower + upper) & (digit > 0) & (lower + upper > 0)
    out[:, 3] = np.minimum(hyphen, 3)
    out[:, 4] = paren > 0
    out[:, 5] = quote > 0
    out[:, 6] = np.where(equal == 0, 0, np.where(n == 1, 1, 2))
    out[:, 7] = np.searchsorted([4, 9, 20], n, side="right")
    out[:, 8] = np.minimum(dot, 2)
    out[:, 9] = a > 0
    out[:, 10] = plus > 0
    out[:, 11] = slash > 0
    return out + _FIRST


# ---- the field ------------------------------------------------------------------------------------------------------

LABELS = ("O",) + tuple(f"{p}-{k}" for k in ADDED_KINDS for p in "BI")


class Field:
    """Weights of the field: emissions of a word's shape and of its neighbours' shapes, transitions, and the start."""

    def __init__(self, emit: np.ndarray, step: np.ndarray, start: np.ndarray) -> None:
        self.emit, self.step, self.start = emit, step, start

    def emissions(self, shape: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """(words, labels). before, after: whether the word has a neighbour in its sequence."""
        own = [self.emit[i][shape].sum(axis=1) for i in range(3)]
        e = own[0].copy()
        e[1:][before[1:]] += own[1][:-1][before[1:]]
        e[:-1][after[:-1]] += own[2][1:][after[:-1]]
        return e

    def decode(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best labels of consecutive sequences with these lengths, by Viterbi over batches of similar length."""
        labels = np.zeros(len(e), np.int64)
        first = np.r_[0, np.cumsum(lengths)[:-1]] if len(lengths) else np.zeros(0, int)
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            longest = max(8, 2 * int(lengths[order[at]]))
            upto = min(int(np.searchsorted(lengths[order], longest, side="right")), at + 4096)
            some = order[at:upto]
            at = upto
            size, n = lengths[some], int(lengths[some].max())
            score = self.start + e[first[some]]
            back = np.zeros((n, len(some), len(self.start)), np.int8)
            for t in range(1, n):
                live = size > t
                paths = score[:, :, None] + self.step
                back[t] = paths.argmax(axis=1)
                new = paths.max(axis=1) + e[np.minimum(first[some] + t, len(e) - 1)]
                score = np.where(live[:, None], new, score)
            best = score.argmax(axis=1)
            for t in range(n - 1, -1, -1):
                live = size > t
                labels[(first[some] + t)[live]] = best[live]
                if t:
                    best = np.where(live, back[t][np.arange(len(some)), best], best)
        return labels


def _sequences(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the words that are in sequences, and the sequences' lengths."""
    special = np.r_[0, np.cumsum(_SPECIAL[data])]
    hot = np.flatnonzero(special[ends] > special[starts])
    if not len(hot):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = np.zeros(len(starts) + 4, bool)
    for d in (-2, -1, 0, 1, 2):
        near[hot + 2 + d] = True
    near = near[2:-2]
    for d in (-2, -1, 1, 2):  # a neighbour in another text is none
        j = hot + d
        ok = (j >= 0) & (j < len(starts))
        other = doc_of[hot[ok]] != doc_of[j[ok]]
        near[j[ok][other]] = False
    near[hot] = True
    # what was cleared from one side may be a neighbour on the other
    for d in (-2, -1, 1, 2):
        j = hot + d
        ok = (j >= 0) & (j < len(starts))
        same = doc_of[hot[ok]] == doc_of[j[ok]]
        near[j[ok][same]] = True
    words = np.flatnonzero(near)
    new = np.r_[True, (np.diff(words) > 1) | (doc_of[words[1:]] != doc_of[words[:-1]])]
    first = np.flatnonzero(new)
    return words, np.diff(np.r_[first, len(words)])


def _ends(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a word has a word before and after it in its sequence."""
    n = int(lengths.sum())
    before, after = np.ones(n, bool), np.ones(n, bool)
    first = np.r_[0, np.cumsum(lengths)[:-1]].astype(int) if len(lengths) else np.zeros(0, int)
    before[first] = False
    after[first + lengths - 1] = False
    return before, after


_EDGE = frozenset(b"\"'`()[]{}<>.,;:!?*#$%&=|")


def added_spans(field: Field, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, start, place of the kind, end) in bytes from the text's start."""
    starts, ends, counts = words_of(data, offsets)
    doc_of = np.repeat(np.arange(len(counts)), counts)
    words, lengths = _sequences(data, starts, ends, doc_of)
    if not len(words):
        return []
    shape = shapes(data, starts[words], ends[words])
    labels = field.decode(field.emissions(shape, *_ends(lengths)), lengths)
    first = np.zeros(len(words), bool)
    first[np.r_[0, np.cumsum(lengths)[:-1]]] = True
    out, at = [], np.flatnonzero(labels)
    done = -1
    for i in at:
        if i <= done:
            continue
        kind, j = (labels[i] - 1) // 2, i
        while j + 1 < len(words) and not first[j + 1] and labels[j + 1] == 2 * kind + 2:
            j += 1
        done = j
        s, e = int(starts[words[i]]), int(ends[words[j]])
        while s < e and data[s] in _EDGE and data[s] != 40:
            s += 1
        while e > s and data[e - 1] in _EDGE:
            e -= 1
        sign = data[s:e].tobytes().find(b"=")  # name=value: the value
        s += sign + 1
        while s < e and data[s] in _EDGE and data[s] != 40:
            s += 1
        if e > s:
            d = int(doc_of[words[i]])
            out.append((d, s - int(offsets[d]), len(BASE_KINDS) + int(kind), e - int(offsets[d])))
    return out


def fit(rows: list[tuple[list[str], list[str]]], rounds: int = 300, penalty: float = 0.02, rate: float = 0.1) -> Field:
    """Maximum likelihood with an L2 penalty by Adam; all sequences are one padded batch, gradients by forward-backward."""
    rows = [(w, l) for w, l in rows if w]
    n_labels, longest = len(LABELS), max(len(w) for w, _ in rows)
    lengths = np.array([len(w) for w, _ in rows])
    raw = [" ".join(w).encode() for w, _ in rows]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    starts, ends, _ = words_of(data, np.array([0, len(data)]))
    shape = shapes(data, starts, ends)
    before, after = _ends(lengths)
    place = np.concatenate([np.arange(n) for n in lengths])
    seq = np.repeat(np.arange(len(rows)), lengths)
    gold = np.array([LABELS.index(x) for _, l in rows for x in l])
    params = [np.zeros((3, N_FEATURES, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    pairs = before  # words that follow another
    for step in range(1, rounds + 1):
        field = Field(*params)
        e = np.full((len(rows), longest, n_labels), -1e9)
        e[seq, place] = field.emissions(shape, before, after)
        # forward and backward sums in log space
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = params[2] + e[:, 0]
        lse = lambda x, ax: (mx := x.max(axis=ax, keepdims=True)).squeeze(ax) + np.log(np.exp(x - mx).sum(axis=ax))
        for t in range(1, longest):
            a[:, t] = np.where((lengths > t)[:, None], lse(a[:, t - 1][:, :, None] + params[1], 1) + e[:, t], a[:, t - 1])
        for t in range(longest - 2, -1, -1):
            b[:, t] = np.where((lengths > t + 1)[:, None], lse(params[1] + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0.0)
        z = lse(a[np.arange(len(rows)), lengths - 1], 1)
        p = np.exp(a[seq, place] + b[seq, place] - z[seq][:, None])
        diff = -p
        diff[np.arange(len(gold)), gold] += 1
        g = [np.zeros_like(x) for x in params]
        for f in range(shape.shape[1]):
            np.add.at(g[0][0], shape[:, f], diff)
            np.add.at(g[0][1], shape[:-1, f][before[1:]], diff[1:][before[1:]])
            np.add.at(g[0][2], shape[1:, f][after[:-1]], diff[:-1][after[:-1]])
        s, t = seq[pairs], place[pairs]
        both = np.exp(a[s, t - 1][:, :, None] + params[1] + (e[s, t] + b[s, t])[:, None, :] - z[s][:, None, None])
        g[1] -= both.sum(axis=0)
        np.add.at(g[1], (gold[np.flatnonzero(pairs) - 1], gold[pairs]), 1)
        g[2] = diff[~before].sum(axis=0)
        for i, x in enumerate(params):
            d = g[i] / len(rows) - penalty * x / len(rows)
            m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.999 * v[i] + 0.001 * d * d
            x += rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Field(*params)


# ---- the labelled table ---------------------------------------------------------------------------------------------

#: Sentences with marked spans; D stands for a digit, H for a hexadecimal digit, ^ for a capital letter or digit.
SENTENCES = """
the log had [secret:AKIA^^^^^^^^^^^^^^^^] in it
an id, [secret:AKIA^^^^^^^^^^^^^^^^], was left there
Then [secret:AKIA^^^^^^^^^^^^^^^^] And more.
with [secret:apikey=HHHHHHHHHHHHHHHH] as its end
the line [secret:key=HHHHHHHHHHHHHHHHHHHH] was cut
Here. Then D. And so. On and on
And. Under DD. Of the. Rooms D. Are
Of the rest. The. D.D. With more. So
Also. Thing DDDDD Then. Other words
Some said. Word. DDDDDDDDDDDDDDDD More. Words
In. All. ab.DD@mail.example.com The. End
Names. Came. DDD.DD.DDD.DD So. They
It was. Then. +D (DDD) DDD-DDDD Or. Not
was so. End [local_phone:(DDD) DDD-DDDD] Of. That
To. This. [local_phone:DDD-DDD-DDDD] In. Which
OF!! THE!! DDDD!! WORDS!! AND
of%%% a### DDDDDDDDDDDDDDDD### in$$$ the***
call [local_phone:DDD-DDD-DDDD] after noon
reach us at [local_phone:(DDD) DDD-DDDD] or by mail
[local_phone:(DDD) DDD-DDDD] is the office
tel. [local_phone:DDD.DDD.DDDD] and ask
dial [local_phone:DDD-DDDD] for help
her number, [local_phone:(DDD) DDD-DDDD], has changed
call [local_phone:(DDD) DDD-DDDD] or [local_phone:DDD-DDD-DDDD] now.
call [local_phone:DDD-DDD-DDDD] and [local_phone:DDD-DDD-DDDD] then
their id is [national_id:DDD-DD-DDDD] on file
number [national_id:DDD-DD-DDDD] was issued
the form asks for [national_id:DDD-DD-DDDD], signed
token = "[secret:HHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHH]" was set
key = "[secret:HHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHH]" in the file
set secret = [secret:HHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHH] and run
the key "[secret:HHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHH]" is old
password: [secret:HHHHHHHHHHHHHHHHHHHHHHHH] was found
in DDDD the town had DDDDD people
on DDDD-DD-DD they met at DD:DD again
it costs DD.DD or DDD in all
version D.D.D of the tool
pages DD-DD and DDD of it
about DDDDDD rows, D.D of them
rooms D, DD and DDD are free
the ratio was D.DDD at DD degrees
score DD-D in the end
write to ab.DD@mail.example.com today
the host DDD.DDD.DD.DDD was down
host DD.DD.DDD.D was up
card DDDDDDDDDDDDDDDD was used
call +D (DDD) DDD-DDDD now
call +DD DDD DDD DDDD now
they said "of the hour" and left
x = y and so on
a "word" in quotes
size = DD and no more
DDDDDDDD items in DDDDDDDDDD boxes
room DDD-D is taken
see DD/DD/DDDD for more
DDDD DDDD DDDD DDDD is a card
order DDDDDDDDDD came in
grade D of DDD-DDD in the list
rows DDD DDD DDDD DDD of it
"""

_MARK = re.compile(r"\[(\w+):([^\]]*)\]")


def labelled_rows(copies: int = 4) -> list[tuple[list[str], list[str]]]:
    """Words and labels of SENTENCES, each filled `copies` times with other digits."""
    rows, state = [], 12345
    for line in SENTENCES.strip().splitlines():
        for _ in range(copies):
            filled = []
            for ch in line:
                state = (state * 1103515245 + 12345) % 2**31
                filled.append(str(state // 65536 % 10) if ch == "D" else "0123456789abcdef"[state // 65536 % 16] if ch == "H" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ23456789"[state // 65536 % 34] if ch == "^" else ch)
            line_now, words, labels = "".join(filled), [], []
            plain, at, spans = "", 0, []
            for m in _MARK.finditer(line_now):
                plain += line_now[at : m.start()]
                spans.append((len(plain), len(plain) + len(m[2]), m[1]))
                plain, at = plain + m[2], m.end()
            plain += line_now[at:]
            for w in re.finditer(r"\S+", plain):
                own = next(((s, k) for s, e, k in spans if w.start() < e and w.end() > s), None)
                words.append(w.group())
                labels.append("O" if own is None else ("B-" if w.start() <= own[0] else "I-") + own[1])
            rows.append((words, labels))
    return rows


def labelled_table(spark: SparkSession) -> DataFrame:
    """(words, labels) of the sentences that the field is trained on."""
    return spark.createDataFrame(labelled_rows(), "words array<string>, labels array<string>")


def train(labelled: DataFrame, most_rows: int = 5000) -> Field:
    """Fits a field to a small labelled table; at most most_rows rows of it (in the order of their words) are used."""
    rows = labelled.filter("size(words) = size(labels)").orderBy(F.array_join("words", " ")).limit(most_rows).collect()
    return fit([(list(r["words"]), list(r["labels"])) for r in rows])


# ---- over documents -------------------------------------------------------------------------------------------------


def spans_of(field: Field, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each text its (start, kind, end) in code points. An added span that meets a base span of its text goes."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    hit = np.zeros(256, bool)
    hit[list(b"0123456789@")] = True
    at = np.flatnonzero(hit[data])
    for d in np.unique(np.searchsorted(offsets, at, side="right") - 1):
        found[d] = base_spans(data[offsets[d] : offsets[d + 1]].tobytes())
    known: dict[int, tuple[list[int], list[int]]] = {}  # of a text's spans so far: the starts, and the furthest end up to each
    for d, s, k, e in added_spans(field, data, offsets):
        if d not in known:
            base = sorted((x, y) for x, _, y in found[d])
            known[d] = [x for x, _ in base], list(accumulate((y for _, y in base), max))
        starts, furthest = known[d]
        i = bisect_left(starts, e)
        if not i or furthest[i - 1] <= s:
            found[d].append((s, k, e))
    rest = np.r_[0, np.cumsum((data & 0xC0) == 0x80)]
    for d, spans in enumerate(found):
        if spans:
            o = int(offsets[d])
            point = lambda p: int(p - (rest[o + p] - rest[o]))
            found[d] = sorted((point(s), k, point(e)) for s, k, e in spans)
    return found


def find(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): for each document its spans of personal data, in code points, sorted by start, then kind.

    Null or empty text: no spans. Repeated rows and null keys are rows like others. Empty table: no rows. Further
    columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(field)

    def run(batches):
        import pyarrow as pa

        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
        for b in batches:
            data, offsets = arrow_bytes(b.column(1))
            spans = []
            for lo, hi in in_slices(np.diff(offsets).tolist(), SLICE):
                own = spans_of(shared.value, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                spans += [[{"kind": KINDS[k], "start": s, "end": e, "base": k < len(BASE_KINDS)} for s, k, e in x] for x in own]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(kind))], names=[key, "spans"])

    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, spans array<{SPAN}>")


def redact(docs: DataFrame, field: Field, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs with each span replaced by its kind in brackets; overlapping spans become one. The columns stay; `length`,
    if it is a column, becomes the new number of code points where the text has changed. Null texts stay null, empty ones
    empty. Repeated rows change alike. Empty table: no rows. Further columns of any name stay as they are."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(field)
    at = docs.columns.index(text)
    at_length = docs.columns.index(length) if length in docs.columns else None

    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, offsets = arrow_bytes(b.column(at))
            changed = {}
            for lo, hi in in_slices(np.diff(offsets).tolist(), SLICE):
                own = spans_of(shared.value, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for i, spans in enumerate(own, lo):
                    if spans:
                        t, out, last = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8"), [], 0
                        for s, k, e in spans:
                            if s >= last:
                                out += [t[last:s], f"[{KINDS[k].upper()}]"]
                            last = max(last, e)
                        changed[i] = "".join([*out, t[last:]])
            cols = list(b.columns)
            if changed:
                texts = cols[at].to_pylist()
                sizes = cols[at_length].to_pylist() if at_length is not None else None
                for i, t in changed.items():
                    texts[i] = t
                    if sizes is not None:
                        sizes[i] = len(t)
                cols[at] = pa.array(texts, cols[at].type)
                if sizes is not None:
                    cols[at_length] = pa.array(sizes, cols[at_length].type)
            yield pa.RecordBatch.from_arrays(cols, names=list(b.schema.names))

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The columns n_<kind>, base_sha256 and spans (as text) in place of the spans."""
    base = F.filter("spans", lambda s: s["base"])
    as_text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    others = [c for c in found.columns if c != "spans"]
    return found.select(*others, *map(count, BASE_KINDS), F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
