"""Personal data: exact patterns, and a character-level BiLSTM with CRF transitions.

The patterns label a bounded sample of the documents; spans are also disturbed (other
separators, other brackets) so that the model learns shapes the patterns do not know. It is
trained in numpy. Documents are read in overlapping windows; the scores of a character are
blended over its windows, and one Viterbi pass per stretch of windows settles the spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stacktally.llm.common import free_name, whole

KINDS = ("email", "ip", "card", "phone")

WINDOW = 96
STRIDE = 48
HIDDEN = 16
EMBEDDED = 12
# Windows that the model is fitted on.
SAMPLE_WINDOWS = 1500
STEPS = 140
BATCH = 48
# A span of the model counts if its tags beat "no span" by this much per character.
MARGIN = 0.5
_WINDOWS_AT_ONCE = 512

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# Every span of every kind holds one of these; elsewhere the tags can only be "no span".
_TRIGGER = re.compile(r"[0-9@]")

Span = tuple[str, int, int]

# --- patterns ------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each at sign, so long runs of letters cost no backtracking."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, in the order of ``KINDS``, then start."""
    if not _TRIGGER.search(text):
        return []
    spans: list[Span] = [("email", a, b) for a, b in _emails(text)]
    spans += [
        ("ip", m.start(), m.end()) for m in _IP.finditer(text)
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))
    ]
    for kind, pattern, least, most in (("card", _CARD, 13, 19), ("phone", _PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = "".join(_DIGIT.findall(m.group()))
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                spans.append((kind, m.start(), m.end()))
    return spans


def plausible(kind: str, found: str) -> bool:
    """Whether a span that the model adds can be what it is taken for."""
    digits = "".join(_DIGIT.findall(found))
    if kind == "email":
        return bool(re.fullmatch(r"\S+@\S*\.\w\w+", re.sub(r"\s+", "", found)))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", found)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and not re.search(r"[A-Za-z]", found)


# --- the model ------------------------------------------------------------------------

# Tags: none, then begin and inside of each kind.
N_TAGS = 1 + 2 * len(KINDS)
_CHARACTERS = " \n\tabcdefghijklmnopqrstuvwxyz0123456789@.+-()_/:,;#*$%&|\"'=<>[]{}!?"
_CODE = np.full(128, 1, dtype=np.int16)
for _i, _c in enumerate(_CHARACTERS):
    _CODE[ord(_c)] = _i + 3
for _c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _CODE[ord(_c)] = _CODE[ord(_c.lower())]
N_CODES = len(_CHARACTERS) + 3  # 0 pads, 1 is another sign, 2 a letter beyond ASCII


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < 128, _CODE[np.minimum(points, 127)], 2).astype(np.int16)


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    """The tag of each character; of overlapping spans the earlier in the list is kept."""
    tags = np.zeros(length, dtype=np.int64)
    for kind, start, end in spans:
        if not tags[start:end].any():
            k = KINDS.index(kind)
            tags[start] = 1 + 2 * k
            tags[start + 1 : end] = 2 + 2 * k
    return tags


def _allowed() -> np.ndarray:
    """Which tag may follow which: "inside" follows "begin" or "inside" of its kind only."""
    ok = np.ones((N_TAGS, N_TAGS), dtype=bool)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        ok[:, inside] = False
        ok[[inside - 1, inside], inside] = True
    return ok


ALLOWED = _allowed()
_NEVER = -1e4


class Network(NamedTuple):
    embedding: np.ndarray
    into: np.ndarray  # 2 directions: EMBEDDED + HIDDEN + 1 rows, 4 * HIDDEN columns
    out: np.ndarray  # 2 * HIDDEN + 1 rows, N_TAGS columns
    moves: np.ndarray  # N_TAGS x N_TAGS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(x: np.ndarray, weights: np.ndarray, keep: bool):
    """Hidden states (time, batch, HIDDEN), and what the gradient needs if ``keep``."""
    steps, batch, _ = x.shape
    fed = x @ weights[:EMBEDDED] + weights[-1]
    recurrent = weights[EMBEDDED:-1]
    h = np.zeros((batch, HIDDEN), dtype=x.dtype)
    c = np.zeros_like(h)
    hidden = np.empty((steps, batch, HIDDEN), dtype=x.dtype)
    memory = []
    for t in range(steps):
        z = fed[t] + h @ recurrent
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        previous = c
        c = f * c + i * g
        squashed = np.tanh(c)
        if keep:
            memory.append((h, previous, i, f, o, g, squashed))
        h = o * squashed
        hidden[t] = h
    return hidden, memory


def _lstm_back(x: np.ndarray, weights: np.ndarray, memory: list, dh_all: np.ndarray):
    gradient = np.zeros_like(weights)
    dx = np.empty_like(x)
    dh = np.zeros_like(dh_all[0])
    dc = np.zeros_like(dh)
    for t in range(len(memory) - 1, -1, -1):
        before, previous, i, f, o, g, squashed = memory[t]
        dh = dh + dh_all[t]
        dc = dc + dh * o * (1 - squashed**2)
        dz = np.concatenate(
            [dc * g * i * (1 - i), dc * previous * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)],
            axis=1,
        )
        gradient[:EMBEDDED] += x[t].T @ dz
        gradient[EMBEDDED:-1] += before.T @ dz
        gradient[-1] += dz.sum(axis=0)
        dx[t] = dz @ weights[:EMBEDDED].T
        dh = dz @ weights[EMBEDDED:-1].T
        dc = dc * f
    return gradient, dx


def emissions(net: Network, codes: np.ndarray) -> np.ndarray:
    """Tag scores (batch, time, N_TAGS) of windows of characters (batch, time)."""
    x = net.embedding[codes.T]
    ahead, _ = _lstm(x, net.into[0], False)
    back, _ = _lstm(x[::-1], net.into[1], False)
    both = np.concatenate([ahead, back[::-1]], axis=2)
    return (both @ net.out[:-1] + net.out[-1]).transpose(1, 0, 2)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _crf_gradient(scores: np.ndarray, moves: np.ndarray, tags: np.ndarray):
    """Loss per character and its gradients; scores are (time, batch, N_TAGS)."""
    steps, batch, _ = scores.shape
    moves = np.where(ALLOWED, moves, _NEVER)
    ahead = np.empty_like(scores)
    ahead[0] = scores[0]
    for t in range(1, steps):
        ahead[t] = _log_sum(ahead[t - 1][:, :, None] + moves, 1) + scores[t]
    back = np.zeros_like(scores)
    for t in range(steps - 2, -1, -1):
        back[t] = _log_sum(moves + (scores[t + 1] + back[t + 1])[:, None, :], 2)
    total = _log_sum(ahead[-1], 1)
    p = np.exp(ahead + back - total[None, :, None])
    d_moves = np.zeros_like(moves)
    gold = scores[np.arange(steps)[:, None], np.arange(batch), tags].sum(axis=0)
    for t in range(1, steps):
        pair = ahead[t - 1][:, :, None] + moves + (scores[t] + back[t])[:, None, :]
        d_moves += np.exp(pair - total[:, None, None]).sum(axis=0)
        gold += moves[tags[t - 1], tags[t]]
        np.add.at(d_moves, (tags[t - 1], tags[t]), -1)
    p[np.arange(steps)[:, None], np.arange(batch), tags] -= 1
    n = steps * batch
    return float((total - gold).sum() / n), p / batch, d_moves / batch


def fit(windows: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, seed: int = 11) -> Network | None:
    """Trains on windows of (codes, tags) of ``WINDOW`` characters by Adam; None without any span."""
    if not any(tags.any() for _, tags in windows):
        return None
    random = np.random.default_rng(seed)
    rows = EMBEDDED + HIDDEN + 1
    net = Network(
        random.normal(0, 0.3, (N_CODES, EMBEDDED)).astype(np.float32),
        random.normal(0, 0.2, (2, rows, 4 * HIDDEN)).astype(np.float32),
        random.normal(0, 0.2, (2 * HIDDEN + 1, N_TAGS)).astype(np.float32),
        np.zeros((N_TAGS, N_TAGS), np.float32),
    )
    net.into[:, -1, HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
    first = [np.zeros_like(p) for p in net]
    second = [np.zeros_like(p) for p in net]
    codes = np.stack([c for c, _ in windows])
    tags = np.stack([t for _, t in windows])
    for step in range(1, steps + 1):
        chosen = random.integers(0, len(codes), BATCH)
        at, gold = codes[chosen].T, tags[chosen].T
        x = net.embedding[at]
        ahead, memory_a = _lstm(x, net.into[0], True)
        back, memory_b = _lstm(x[::-1], net.into[1], True)
        both = np.concatenate([ahead, back[::-1]], axis=2)
        scores = both @ net.out[:-1] + net.out[-1]
        _, d_scores, d_moves = _crf_gradient(scores, net.moves, gold)
        d_out = np.concatenate([
            np.einsum("tbh,tbk->hk", both, d_scores), d_scores.sum(axis=(0, 1))[None],
        ])
        d_both = d_scores @ net.out[:-1].T
        into_a, dx_a = _lstm_back(x, net.into[0], memory_a, d_both[:, :, :HIDDEN])
        into_b, dx_b = _lstm_back(x[::-1], net.into[1], memory_b, d_both[::-1, :, HIDDEN:])
        d_embedding = np.zeros_like(net.embedding)
        np.add.at(d_embedding, at, dx_a + dx_b[::-1])
        gradients = [d_embedding, np.stack([into_a, into_b]), d_out, d_moves]
        size = np.sqrt(sum(float((g**2).sum()) for g in gradients))
        rate = 0.02 * (1 - 0.8 * step / steps)
        for p, g, m, v in zip(net, gradients, first, second):
            g = g * min(1.0, 5.0 / (size + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g**2 - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best allowed tags of one stretch (time, N_TAGS)."""
    moves = np.where(ALLOWED, moves, _NEVER)
    best = scores[0].copy()
    best[2::2] = _NEVER
    came = np.empty(scores.shape, dtype=np.int8)
    for t in range(1, len(scores)):
        through = best[:, None] + moves
        came[t] = through.argmax(axis=0)
        best = through.max(axis=0) + scores[t]
    tags = np.empty(len(scores), dtype=np.int64)
    tags[-1] = best.argmax()
    for t in range(len(scores) - 1, 0, -1):
        tags[t - 1] = came[t, tags[t]]
    return tags


# --- training windows ---------------------------------------------------------------------


def _disturbed(kind: str, value: str, seed: int) -> str:
    """The value in another notation, of the same kind."""
    if kind == "email":
        return value.replace("@", (" @ ", "(@)", "@", " @")[seed % 4])
    if kind == "ip":
        return value.replace(".", ("-", " . ", ":", "_")[seed % 4])
    if kind == "card":
        digits = "".join(_DIGIT.findall(value))
        return (".", "/", "_", "  ")[seed % 4].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    digits = "".join(_DIGIT.findall(value))[-10:]
    a, b, c = digits[:3], digits[3:6], digits[6:]
    return (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1/{a}/{b}/{c}", f"00{a} {b} {c}")[seed % 4]


def training_windows(text: str, most: int = 6) -> list[tuple[str, list[Span]]]:
    """Windows of one text with their labelled spans: as found, disturbed, and without any.

    Where the windows lie follows from a hash of the text, not from chance.
    """
    if not _TRIGGER.search(text):
        return []
    spans = base_spans(text)
    h = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    out: list[tuple[str, list[Span]]] = []
    for n, (kind, start, end) in enumerate(spans[: most // 2]):
        if end - start > WINDOW - 16:
            continue
        left = max(0, start - (h >> n) % (WINDOW - (end - start) - 8))
        inside = [(k, a - left, b - left) for k, a, b in spans if a >= left and b <= left + WINDOW]
        if not any(a < left + WINDOW < b or a < left < b for _, a, b in spans):
            out.append((text[left : left + WINDOW], inside))
        value = _disturbed(kind, text[start:end], (h >> (3 * n)) & 3)
        lead, tail = text[max(0, start - 24) : start], text[end : end + 24]
        if not _TRIGGER.search(lead + tail):
            out.append((lead + value + tail, [(kind, len(lead), len(lead) + len(value))]))
    found = _TRIGGER.search(text, h % len(text))
    if found:
        left = max(0, found.start() - h % WINDOW)
        if not any(a < left + WINDOW and b > left for _, a, b in spans):
            out.append((text[left : left + WINDOW], []))
    return out


_WINDOWS = T.ArrayType(T.StructType([
    T.StructField("chars", T.StringType()), T.StructField("spans", T.StringType()),
]))


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def spans_from(text: str) -> list[Span]:
    parts = [p.split(":") for p in text.split(",") if p]
    return [(k, int(a), int(b)) for k, a, b in parts]


@F.pandas_udf(_WINDOWS)
def _training(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([
            [{"chars": c, "spans": spans_text(s)} for c, s in training_windows(t)] for t in batch
        ], dtype=object)


def train(docs: DataFrame, windows: int = SAMPLE_WINDOWS, steps: int = STEPS) -> Network | None:
    """Fits the model on at most ``windows`` different windows, chosen by a hash of their text.

    None if no document has any span: then nothing is added to the patterns.
    """
    found = docs.select(F.explode(_training(whole(F.col("text")))).alias("w")).select("w.*").distinct()
    order = F.xxhash64("chars", "spans")
    rows = found.orderBy(order, "chars").limit(windows).collect()
    data = []
    for row in rows:
        codes = np.zeros(WINDOW, dtype=np.int16)
        tags = np.zeros(WINDOW, dtype=np.int64)
        encoded = encode(row["chars"])[:WINDOW]
        codes[: len(encoded)] = encoded
        tags[: len(encoded)] = tags_of(max(len(row["chars"]), WINDOW), spans_from(row["spans"]))[: len(encoded)]
        data.append((codes, tags))
    return fit(data, steps)


# --- finding -----------------------------------------------------------------------------


def _stretches(text: str) -> list[tuple[int, int]]:
    """Runs of overlapping windows that hold a trigger: (first, one past the last) by stride."""
    out: list[list[int]] = []
    last = max(0, (len(text) - WINDOW + STRIDE - 1) // STRIDE)
    for m in _TRIGGER.finditer(text):
        low = min(max(0, (m.start() - WINDOW) // STRIDE + 1), last)
        high = min(m.start() // STRIDE, last) + 1
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


# A character counts most in the middle of a window.
_BLEND = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)


def model_spans(net: Network, texts: list[str]) -> list[list[Span]]:
    """Spans that the model sees in each text, whole texts, by overlapping windows."""
    jobs = [(i, a, b) for i, t in enumerate(texts) for a, b in _stretches(t)]
    windows = [(j, k) for j, (_, a, b) in enumerate(jobs) for k in range(a, b)]
    encoded = {i: encode(texts[i]) for i, _, _ in jobs}
    sums = {j: np.zeros(((b - a - 1) * STRIDE + WINDOW, N_TAGS), np.float32) for j, (_, a, b) in enumerate(jobs)}
    weights = {j: np.zeros((len(s), 1), np.float32) for j, s in sums.items()}
    for start in range(0, len(windows), _WINDOWS_AT_ONCE):
        chunk = windows[start : start + _WINDOWS_AT_ONCE]
        codes = np.zeros((len(chunk), WINDOW), dtype=np.int16)
        for row, (j, k) in zip(codes, chunk):
            piece = encoded[jobs[j][0]][k * STRIDE : k * STRIDE + WINDOW]
            row[: len(piece)] = piece
        for (j, k), scores in zip(chunk, emissions(net, codes)):
            at = (k - jobs[j][1]) * STRIDE
            sums[j][at : at + WINDOW] += scores * _BLEND[:, None]
            weights[j][at : at + WINDOW] += _BLEND[:, None]
    out: list[list[Span]] = [[] for _ in texts]
    for j, (i, a, _) in enumerate(jobs):
        offset = a * STRIDE
        scores = (sums[j] / weights[j])[: len(texts[i]) - offset]
        tags = viterbi(scores, net.moves)
        for start in np.flatnonzero(tags % 2 == 1).tolist():
            end = start + 1
            while end < len(tags) and tags[end] == tags[start] + 1:
                end += 1
            margin = (scores[np.arange(start, end), tags[start:end]] - scores[start:end, 0]).mean()
            kind = KINDS[(int(tags[start]) - 1) // 2]
            if margin >= MARGIN and plausible(kind, texts[i][offset + start : offset + end]):
                out[i].append((kind, offset + start, offset + end))
    return out


def all_spans(net: Network | None, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and base spans with those the model adds; added ones overlap no other."""
    base = [base_spans(t) for t in texts]
    added = model_spans(net, texts) if net is not None else [[] for _ in texts]
    out = []
    for text, found, more in zip(texts, base, added):
        merged = list(found)
        if more:
            taken = bytearray(len(text))
            for _, a, b in found:
                taken[a:b] = b"\1" * (b - a)
            for kind, a, b in more:
                if not any(taken[a:b]):
                    taken[a:b] = b"\1" * (b - a)
                    merged.append((kind, a, b))
        merged.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
        out.append((found, merged))
    return out


_FOUND = T.StructType([
    *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
    T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType()),
    T.StructField("redacted", T.StringType()),
])


def redact(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in brackets; overlapping spans go as one, by the first."""
    parts, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            parts += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*parts, text[end:]])


def _finder(net: Network | None, with_text: bool):
    @F.pandas_udf(_FOUND)
    def finder(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for start in range(0, len(batch), 64):
                part = batch.iloc[start : start + 64].tolist()
                for text, (base, spans) in zip(part, all_spans(net, part)):
                    counts = [sum(s[0] == k for s in base) for k in KINDS]
                    rows.append((
                        *counts, spans_text(base), spans_text(spans), redact(text, spans) if with_text else None
                    ))
            yield pd.DataFrame(rows, columns=_FOUND.names)

    return finder


def find(
    docs: DataFrame, net: Network | None, redacted: bool = False, name: str = "pii"
) -> DataFrame:
    """``docs`` with struct ``pii``: counts and text of the base spans, of all spans, and the
    redacted text if asked for.

    Spans are kind:start:end in code points. Whole texts are read; a null or empty text has no
    spans. Repeated rows get equal results; a column ``pii`` of ``docs`` is replaced.
    """
    return docs.withColumn(name, _finder(net, redacted)(whole(F.col("text"))))


def scrub(docs: DataFrame, net: Network | None) -> DataFrame:
    """``docs`` with all spans taken out of ``text``; ``n_chars``, if there, counts the new text.

    A null text stays null.
    """
    name = free_name(docs, "pii")
    found = find(docs, net, redacted=True, name=name)
    found = found.withColumn("text", F.when(F.col("text").isNotNull(), F.col(f"{name}.redacted")))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        found = found.withColumn(
            "n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind)
        )
    return found.drop(name)
