"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds spans.

The patterns give the base spans. The field reads a text as tokens (runs of letters, runs of digits, single marks), each
with a shape class; it is trained on the small table below and decoded by Viterbi in numpy batches over all tokens. A
token whose emission favours "outside" by more than transitions can ever make up is outside in the best path, so the
text is cut there exactly and only the stretches between are decoded. A decoded stretch becomes a span if it overlaps
no base span and its digits fit its kind (lengths, checksum, ranges).

Positions are code points, the end is exclusive. Null and empty texts have no spans. Repeated rows get equal results.
Extra columns are left alone.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import chunks, read_table

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match takes whole runs of digits, so one can only begin where no digit stands before; that keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

# The labelled table. [kind ...] marks a span.
LABELLED = """
call me at [phone 555-123-4567] after noon
her number is [phone (555) 123-4567] now
tel [phone 030 1234 5678] office
phone: [phone 0171-2345678]
fax [phone (030) 555 12 34]
mobile [phone 07700 900123] or mail
ring [phone 555.867.5309] today
telefon [phone 089/1234567] ab acht
please phone [phone 212 555 0187] soon
call [phone 01 23 45 67 89] before ten
tel. [phone 91 555 12 34 56]
write to [email jane.doe (at) example.com] please
mail [email bob at example dot com] for help
contact [email info [at] example [dot] org] today
mail: [email anna.m at mail dot example dot net]
email [email john_smith (at) mail.example.com] now
reach [email support at example dot com]
from [ip 10 . 0 . 0 . 12] came the request
server [ip 192.168.1[.]10] answered
host [ip 172[.]16[.]0[.]5] is down
address [ip 10.1.2[.]3] blocked
card [card 4111.1111.1111.1111] was charged
visa [card 4012_8888_8888_1881] expires soon
card number [card 5500/0000/0000/0004] declined
pay with [card 4111 - 1111 - 1111 - 1111] please
the meeting is on 2024-01-05 in room 12
it costs 12.50 euros or 1,200 in all
version 3.12.1 was released in 2023
at 10:30 we meet at the station
order no. 123456 was sent on 05/06/2023
chapter 3, section 4.2, page 117
in 1998 there were 300 people at the fair
see figure 2.1 and table 10-3
he ran 10 km in 45 minutes at most
the dot at the end of the line
we stayed at home and at work
a score of 3 - 2 or 4:1
about 1 000 000 copies were sold
section 1.2.3.4.5 of the manual
(see note 12) and (in 2001) again
born 12.03.1985 in a small town
flight 1234 leaves at 6 from gate 22
isbn 978-3-16 was not found
the ratio was 1/3 and then 2/3
from 10 to 20 percent of all cases
mix 2 parts of flour with 1 part of water
line one, line two; and so on.
the and of with, there are many words here.
It was a bright day. Nobody spoke. They went on.
Der Mann ging nach Hause, und es war spät.
La maison est grande et le jardin est petit.
El perro de la casa no quiere salir hoy.
NOTE: ALL WORDS ARE WRITTEN IN CAPITALS HERE
key=abc123def456 and "id" = 99
sha 3f2a9c 77be01 12d4
commit 9f8e7d6c fixed it
temperature 21.5 degrees, wind 12 knots
total 4 items, 3 boxes and 2 bags
word word word word word word word word
one two. three four? five six! seven: eight
"""
WORDS = ("at", "dot", "tel", "phone", "call", "fax", "mobile", "telefon", "ring", "mail", "email", "card", "visa", "host", "server", "ip")
MARKS = ".-()@+/:,_[]"
N_SHAPES = 8 + len(WORDS) + 7 + len(MARKS) + 2
STATES = ("", *KINDS)
K = len(STATES)
SEPARATOR = "\n\x00\n"
LONG = 4_096  # stretches of more tokens are decoded in blocks


def _word_key(text: str) -> int:
    return sum(ord(c) * 131**k for k, c in enumerate(text)) % (1 << 31)


_KEYS = np.array([_word_key(w) for w in WORDS])


@dataclass
class Tokens:
    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray
    gap: np.ndarray  # space before


def tokenize(text: str) -> Tokens:
    """Tokens of a text with shape classes, without a loop over characters."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    kind = np.full(len(codes), 3, np.int8)
    digit = (codes >= 48) & (codes <= 57)
    lower = codes | 32
    letter = ((lower >= 97) & (lower <= 122)) | (codes >= 192)
    kind[letter], kind[digit], kind[codes <= 32] = 1, 2, 0
    kind[codes == 160] = 0
    new = np.ones(len(codes), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    at = np.flatnonzero(new)
    stop = np.append(at[1:], len(codes))
    space = kind[at] == 0
    gap = np.concatenate([[True], space[:-1]]) if len(at) else np.zeros(0, bool)
    keep = ~space
    at, stop, gap = at[keep], stop[keep], gap[keep]
    size, k = stop - at, kind[at]
    shape = np.full(len(at), N_SHAPES - 1)
    first_upper = (codes[at] >= 65) & (codes[at] <= 90)
    second = codes[np.minimum(at + 1, len(codes) - 1)] if len(codes) else codes
    all_upper = first_upper & (size > 1) & (second >= 65) & (second <= 90)
    words = k == 1
    base = np.where(codes[at] >= 192, 6, np.where(all_upper, 4, np.where(first_upper, 2, 0))) + (size > 3)
    shape[words] = base[words]
    short = words & (size <= 7)
    key = np.zeros(len(at), np.int64)
    for j in range(7):
        in_word = short & (size > j)
        key[in_word] += lower[at[in_word] + j] * 131**j
    key %= 1 << 31
    for n, wanted in enumerate(_KEYS):
        shape[short & (key == wanted) & (size == len(WORDS[n]))] = 8 + n
    digits = k == 2
    shape[digits] = 8 + len(WORDS) + np.searchsorted([1, 2, 3, 4, 6, 9], size[digits])
    for n, mark in enumerate(MARKS):
        shape[(k == 3) & (codes[at] == ord(mark))] = 15 + len(WORDS) + n
    shape[(k == 3) & (codes[at] == 0)] = N_SHAPES - 2
    return Tokens(at, stop, shape, gap)


def features(t: Tokens) -> list[np.ndarray]:
    """Nine feature numbers for each token: own shape, neighbours within two, pairs, spaces."""
    s, n = t.shape, N_SHAPES
    edge = n - 2
    pad = np.concatenate([[edge, edge], s, [edge, edge]])
    before, after, before2, after2 = pad[1:-3], pad[3:-1], pad[:-4], pad[4:]
    gap_after = np.append(t.gap[1:], True)
    gaps = t.gap * 2 + gap_after
    blocks = [s, before, after, before2, after2, before * n + s, s * n + after, s * 4 + gaps, before2 * n + after2]
    widths = [n] * 5 + [n * n, n * n, n * 4, n * n]
    offset = np.concatenate([[0], np.cumsum(widths)])
    return [b + o for b, o in zip(blocks, offset)]


N_FEATURES = 5 * N_SHAPES + 3 * N_SHAPES * N_SHAPES + 4 * N_SHAPES


@dataclass
class Field:
    """Weights: emission for each feature and state, transition between states (state 0 is outside)."""

    emission: np.ndarray
    transition: np.ndarray


def labelled_rows(table: str = LABELLED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, spans) of the table; a span is (start, end, state)."""
    out = []
    for line in table.strip().split("\n"):
        text, spans, rest = "", [], line
        while m := re.search(r"\[(email|ip|card|phone) ", rest):
            text += rest[: m.start()]
            depth, k = 1, m.end()
            while depth:
                depth += {"[": 1, "]": -1}.get(rest[k], 0)
                k += 1
            body = rest[m.end() : k - 1]
            spans.append((len(text), len(text) + len(body), STATES.index(m[1])))
            text, rest = text + body, rest[k:]
        out.append((text + rest, spans))
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def train(rows: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 250, rate: float = 0.08, ridge: float = 1e-3, stiff: float = 5e-2) -> Field:
    """Maximum likelihood with a ridge, by Adam with forward-backward over all rows at once; no randomness.

    ``stiff``: the ridge of the transitions, stronger, so that the emissions decide and most tokens are surely outside.
    """
    seqs = []
    for text, spans in rows:
        t = tokenize(text)
        state = np.zeros(len(t.start), int)
        for a, b, k in spans:
            state[(t.start >= a) & (t.end <= b)] = k
        seqs.append((np.stack(features(t), 1), state))
    n, longest = len(seqs), max(len(s) for _, s in seqs)
    feats, gold, mask = np.zeros((n, longest, 9), int), np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (f, s) in enumerate(seqs):
        feats[i, : len(s)], gold[i, : len(s)], mask[i, : len(s)] = f, s, True
    emission, transition = np.zeros((N_FEATURES, K)), np.zeros((K, K))
    moments = [np.zeros_like(a) for a in (emission, transition, emission, transition)]
    one_hot = np.eye(K)[gold] * mask[:, :, None]
    for step in range(1, epochs + 1):
        e = emission[feats].sum(2)
        alpha, beta = np.zeros((n, longest, K)), np.zeros((n, longest, K))
        alpha[:, 0] = e[:, 0] + transition[0]
        for j in range(1, longest):
            nxt = _log_sum(alpha[:, j - 1, :, None] + transition, 1) + e[:, j]
            alpha[:, j] = np.where(mask[:, j, None], nxt, alpha[:, j - 1])
        beta[:, -1] = transition[:, 0]
        for j in range(longest - 2, -1, -1):
            nxt = _log_sum(transition + (e[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
            beta[:, j] = np.where(mask[:, j + 1, None], nxt, transition[:, 0])
        total = _log_sum(alpha[:, -1] + transition[:, 0], 1)
        unary = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
        pair = np.exp(alpha[:, :-1, :, None] + transition + (e + beta)[:, 1:, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
        grad_t = pair.sum((0, 1)) - np.einsum("ijk,ijl->kl", one_hot[:, :-1], one_hot[:, 1:])
        last = mask.sum(1) - 1
        rng = np.arange(n)
        grad_t[0] += (unary[:, 0] - one_hot[:, 0]).sum(0)
        grad_t[:, 0] += (unary[rng, last] - one_hot[rng, last]).sum(0)
        diff = unary - one_hot
        grad_e = np.zeros_like(emission)
        for c in range(9):
            np.add.at(grad_e, feats[:, :, c].ravel(), diff.reshape(-1, K))
        for p, g, m, v in ((emission, grad_e + ridge * emission * n, moments[0], moments[2]), (transition, grad_t + stiff * transition * n, moments[1], moments[3])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(emission, transition)


def decode(t: Tokens, field: Field) -> np.ndarray:
    """States of all tokens on the best path."""
    n = len(t.start)
    states = np.zeros(n, np.int8)
    if not n:
        return states
    weights = field.emission.astype(np.float32)
    e = np.zeros((n, K), np.float32)
    for f in features(t):
        e += weights.take(f, axis=0)
    e[t.shape == N_SHAPES - 2, 1:] = -1e6  # a text's edge is outside
    # the most that state k can gain by its transitions over outside, whatever its neighbours are
    tr = field.transition
    gain = np.array([(tr[:, k] - tr[:, 0]).max() + (tr[k] - tr[0]).max() for k in range(1, K)], np.float32)
    open_ = (e[:, 1:] + gain >= e[:, :1]).any(1)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], open_, [False]]).astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    size = end - begin
    for k in np.flatnonzero(size > LONG):
        states[begin[k] : end[k]] = _long_viterbi(e[begin[k] : end[k]], field.transition)
    begin, size = begin[size <= LONG], size[size <= LONG]
    for lo in np.unique(np.ceil(np.log2(np.maximum(size, 1)))):  # stretches of like lengths together
        group = np.flatnonzero(np.ceil(np.log2(np.maximum(size, 1))) == lo)
        width = int(size[group].max())
        for k in range(0, len(group), max(1, 200_000 // width)):
            g = group[k : k + max(1, 200_000 // width)]
            states_of = _viterbi(e, begin[g], size[g], width, field.transition)
            for i, b, s in zip(range(len(g)), begin[g], size[g]):
                states[b : b + s] = states_of[i, :s]
    return states


def _viterbi(e: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int, transition: np.ndarray) -> np.ndarray:
    """Best states of stretches between outside tokens; shorter ones are padded by standing still."""
    n = len(begin)
    score = e[begin] + transition[0]
    back = np.zeros((n, width, K), np.int8)
    for j in range(1, width):
        live = size > j
        step = score[:, :, None] + transition
        back[:, j] = step.argmax(1)
        nxt = step.max(1) + e[np.minimum(begin + j, len(e) - 1)]
        back[~live, j] = np.arange(K)
        score = np.where(live[:, None], nxt, score)
    out = np.zeros((n, width), np.int8)
    out[:, -1] = (score + transition[:, 0]).argmax(1)
    rows = np.arange(n)
    for j in range(width - 1, 0, -1):
        out[:, j - 1] = back[rows, j, out[:, j]]
    return out


def _long_viterbi(e: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Best states of one long stretch between outside tokens, all its blocks at once.

    A block's best scores from each state to each state make a matrix; the matrices are gone through in order, which gives the
    state at each border, and then all blocks are decoded between their borders.
    """
    steps = math.isqrt(len(e) - 1) + 1
    blocks = -(-len(e) // steps)
    part = np.zeros((blocks * steps, K))
    part[: len(e)] = e
    part = part.reshape(blocks, steps, K)
    live = (np.arange(blocks * steps) < len(e)).reshape(blocks, steps)
    still = np.where(np.eye(K, dtype=bool), 0.0, -np.inf)
    best = np.tile(still, (blocks, 1, 1))
    for j in range(steps):
        step = (best[:, :, :, None] + transition).max(2) + part[:, j, None, :]
        best = np.where(live[:, j, None, None], step, best)
    score, entry = still[0], np.zeros((blocks, K))
    for b in range(blocks):
        entry[b] = score
        score = (score[:, None] + best[b]).max(0)
    leave = np.zeros(blocks, int)
    leave[-1] = (score + transition[:, 0]).argmax()
    for b in range(blocks - 1, 0, -1):
        leave[b - 1] = (entry[b] + best[b][:, leave[b]]).argmax()
    score = still[np.append(0, leave[:-1])]
    back = np.zeros((steps, blocks, K), np.int8)
    for j in range(steps):
        step = score[:, :, None] + transition
        back[j] = np.where(live[:, j, None], step.argmax(1), np.arange(K))
        score = np.where(live[:, j, None], step.max(1) + part[:, j], score)
    out, rows, now = np.zeros((blocks, steps), np.int8), np.arange(blocks), leave
    for j in range(steps - 1, -1, -1):
        out[:, j] = now
        now = back[j][rows, now]
    return out.ravel()[: len(e)]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of EMAIL from the left: each starts at the run of local-part characters before an @."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_PART:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            out.append(m.span())
            done = m.end()
        at = text.find("@", max(done, at + 1))
    return out


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, in the order of KINDS, then by start."""
    out = [("email", a, b) for a, b in emails(text)]
    if not DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def fits(kind: str, text: str) -> bool:
    """Whether a decoded stretch can be of its kind."""
    d = digits_of(text)
    if kind == "phone":
        return 8 <= len(d) <= 15 and len(text) <= 24
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return re.search(r"(?i)[a-z0-9]\W+at\W+[a-z0-9-]+(\W+dot\W+|\.)[a-z]", text) is not None and len(text) <= 80


def _free(spans: list[tuple[str, int, int]]):
    """Whether a stretch overlaps none of the spans: the farthest end of those that begin before its end decides."""
    order = sorted((a, b) for _, a, b in spans)
    begins, reach = [a for a, _ in order], [0]
    for _, b in order:
        reach.append(max(reach[-1], b))
    return lambda lo, hi: reach[bisect_left(begins, hi)] <= lo


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]], field: Field) -> list[list[tuple[str, int, int]]]:
    """Spans that the field finds beside the base ones, for each text."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    t = tokenize(SEPARATOR.join(texts))
    states = decode(t, field)
    change = np.flatnonzero(np.diff(np.concatenate([[0], states, [0]])))
    starts = np.cumsum([0] + [len(x) + len(SEPARATOR) for x in texts])
    taken = [_free(spans) for spans in base]
    for a, b in zip(change[:-1], change[1:]):
        if not states[a]:
            continue
        n = int(np.searchsorted(starts, t.start[a], "right")) - 1
        lo, hi = int(t.start[a] - starts[n]), int(t.end[b - 1] - starts[n])
        kind = STATES[states[a]]
        if hi <= len(texts[n]) and fits(kind, texts[n][lo:hi]) and taken[n](lo, hi):
            out[n].append((kind, lo, hi))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added): the spans of each document as arrays of (kind, start, end)."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(field)  # fixed size
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "_text", 1_000_000):
            base = [base_spans(x) for x in texts]
            more = added_spans(texts, base, shared.value)
            cols = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in row] for row in side], span) for side in (base, more)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[id_col, "base", "added"])

    spans = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, base {spans}, added {spans}")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{k}]"]
            at = b
    return "".join([*out, text[at:]])


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and spans, and all spans, of every document."""
    found = find(read_table(spark, sf_dir, "documents"), train(labelled_rows()))
    order = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    line = lambda c: F.array_join(
        F.transform(F.array_sort(F.transform(c, lambda s: F.struct(order(s).alias("o"), s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("k")))),
                    lambda s: F.concat_ws(":", s["k"], s["s"], s["e"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added")
    )
