"""Personal data: fixed patterns, and a linear-chain conditional random field.

The patterns find what is written by the rules.  The field reads word shapes (runs
of character classes, counts of digits and marks, the words around) and adds
spans the patterns miss: a number without its plus, an address with "(at)".
It is trained from a small labelled table and decoded by Viterbi, many stretches
of text at a time.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.store import texts
from candlewick.llm.textkit import Words, ids, lower, mix, powers, slices

KINDS = ("email", "ip", "card", "phone")
STATES = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# no match begins inside a run of digits whose start gave none
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_AT = re.compile(r"^(?:[^@\s]+@|[^@\s]+\s+[(\[]?at[)\]]?\s+)[^@\s]+(?:\.|\s+[(\[]?dot[)\]]?\s+)[^@\s]+", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _valid_ip(s: str) -> bool:
    # a part may begin with any number of zeros
    told = [p.lstrip("0") or "0" for p in s.split(".")]
    return all(len(p) <= 3 and int(p) <= 255 for p in told)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the patterns, leftmost and not overlapping within a kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if m and start < at:
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if _valid_ip(m[0]):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = "".join(_DIGITS.findall(m[0]))
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
            out.append((3, *m.span()))
    return out


# ---------------------------------------------------------------- features

_CLASS = np.full(256, 9, np.uint8)
for _c in range(256):
    if 97 <= _c <= 122 or _c >= 128:
        _CLASS[_c] = 0
    elif 65 <= _c <= 90:
        _CLASS[_c] = 1
    elif 48 <= _c <= 57:
        _CLASS[_c] = 2
for _i, _c in enumerate(b"@.-+(:/"):
    _CLASS[_c] = 3 + _i
_CLASS[list(b")[]")] = 7
SHAPES, MARKS, NAMES = 1 << 12, 20 * 2 * 4 * 2 + 1, 8
_SPELLED = (b"at", b"(at)", b"[at]", b"dot", b"(dot)", b"[dot]", b"tel")


def _name_hashes() -> np.ndarray:
    return np.array([Words(np.frombuffer(w, np.uint8), np.array([0, len(w)])).hashes()[0] for w in _SPELLED], np.uint64)


def word_features(words: Words) -> np.ndarray:
    """words x 7: shape; marks of the word, the one before and the one after; spelled-out mark likewise.
    Beyond the ends of a text stand a mark and a name of their own."""
    n = len(words)
    cls = _CLASS[words.data]
    size = len(cls)
    change = np.ones(size, bool)
    change[1:] = cls[1:] != cls[:-1]
    change[words.start] = True
    change &= ~words.blank
    at = np.flatnonzero(change)
    total = np.zeros(len(at) + 1, np.uint64)
    g = np.uint64(0x9E3779B97F4A7C15)
    np.cumsum((cls[at].astype(np.uint64) + np.uint64(1)) * powers(g, len(at))[:-1], out=total[1:], dtype=np.uint64)
    first, last = np.searchsorted(at, words.start), np.searchsorted(at, words.end)
    shape = mix((total[last] - total[first]) * powers(np.uint64(pow(int(g), -1, 1 << 64)), len(at))[first]) >> np.uint64(52)

    def count(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return c[words.end] - c[words.start]

    marks = np.minimum(count(cls == 2), 19)
    marks = ((marks * 2 + np.minimum(count(cls == 3), 1)) * 4 + np.minimum(count(cls == 4), 3)) * 2 + np.minimum(count(cls == 6), 1)
    hashes = Words(lower(words.data), words.off).hashes() if n else np.zeros(0, np.uint64)
    names = np.zeros(n, np.int64)
    for i, h in enumerate(_name_hashes()):
        names[hashes == h] = i + 1
    out = np.empty((n, 7), np.int32)
    begin, end = np.zeros(n, bool), np.zeros(n, bool)
    begin[words.first[:-1][words.counts() > 0]] = True
    end[words.first[1:][words.counts() > 0] - 1] = True
    out[:, 0], out[:, 1], out[:, 4] = shape, marks, names
    for column, values, edge in ((2, marks, MARKS - 1), (5, names, 0)):
        before, after = np.roll(values, 1), np.roll(values, -1)
        out[:, column], out[:, column + 1] = np.where(begin, edge, before), np.where(end, edge, after)
    return out


SIZES = (SHAPES, MARKS, MARKS, MARKS, NAMES, NAMES, NAMES)
_OFFSETS = np.concatenate([[0], np.cumsum(SIZES)])


@dataclass(frozen=True)
class Field:
    """``weights``: features x states; ``move``: from state x to state (outside before and after a text)."""

    weights: np.ndarray
    move: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), STATES), np.float32)
        for i in range(features.shape[1]):
            out += self.weights[features[:, i] + _OFFSETS[i]]
        return out


def _allowed() -> np.ndarray:
    """An inside follows its begin or itself only."""
    ok = np.ones((STATES, STATES), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


def train(sequences: list[tuple[list[str], list[int]]], epochs: int = 60, rate: float = 0.1, decay: float = 1e-3, seed: int = 3) -> Field:
    """Conditional likelihood by forward-backward, all sequences at once, Adam steps."""
    n, width = len(sequences), max(len(w) for w, _ in sequences)
    joined = [" ".join(w).encode() for w, _ in sequences]
    off = np.concatenate([[0], np.cumsum([len(x) for x in joined])])
    words = Words(np.frombuffer(b"".join(joined), np.uint8), off)
    size = words.counts()
    mask = np.arange(width) < size[:, None]
    feature = np.zeros((n, width, 7), np.int64)
    feature[mask] = word_features(words) + _OFFSETS[:-1]
    label = np.zeros((n, width), np.int64)
    label[mask] = [y for _, ys in sequences for y in ys]
    weights, move = np.zeros((int(_OFFSETS[-1]), STATES)), np.where(_allowed(), 0.0, -30.0)
    gold, gold_move = np.zeros_like(weights), np.zeros_like(move)
    for i in range(7):
        np.add.at(gold, (feature[mask][:, i], label[mask]), 1)
    pair = mask[:, 1:]
    np.add.at(gold_move, (label[:, :-1][pair], label[:, 1:][pair]), 1)
    np.add.at(gold_move, (np.zeros(n, int), label[:, 0]), 1)
    np.add.at(gold_move, (label[np.arange(n), size - 1], np.zeros(n, int)), 1)
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(move), np.zeros_like(move)]

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for t in range(1, epochs + 1):
        emit = weights[feature].sum(axis=2)
        alpha, beta = np.zeros((n, width, STATES)), np.zeros((n, width, STATES))
        alpha[:, 0] = move[0] + emit[:, 0]
        for j in range(1, width):
            step = lse(alpha[:, j - 1][:, :, None] + move, 1) + emit[:, j]
            alpha[:, j] = np.where(mask[:, j][:, None], step, alpha[:, j - 1])
        whole = lse(alpha[:, -1] + move[:, 0], 1)
        beta[:, -1] = move[:, 0]
        for j in range(width - 2, -1, -1):
            step = lse(move + (emit[:, j + 1] + beta[:, j + 1])[:, None, :], 2)
            beta[:, j] = np.where(mask[:, j + 1][:, None], step, move[:, 0])
        p = np.exp(np.minimum(0, alpha + beta - whole[:, None, None])) * mask[:, :, None]
        want, want_move = np.zeros_like(weights), np.zeros_like(move)
        for i in range(7):
            np.add.at(want, feature[mask][:, i], p[mask])
        both = alpha[:, :-1][:, :, :, None] + move + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - whole[:, None, None, None]
        want_move += (np.exp(np.minimum(0, both)) * pair[:, :, None, None]).sum(axis=(0, 1))
        want_move[0] += p[:, 0].sum(axis=0)
        want_move[:, 0] += p[np.arange(n), size - 1].sum(axis=0)
        for x, g, m, v in ((weights, (want - gold) / n + decay * weights, state[0], state[1]), (move, (want_move - gold_move) / n + decay * move * _allowed(), state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        move[~_allowed()] = -30.0
    return Field(weights.astype(np.float32), move.astype(np.float32))


def viterbi(field: Field, emit: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best state of every word; ``first`` bounds the texts.

    A word whose "outside" leads all other states by more than moves can make up for
    is outside in every best path, so texts fall apart there and the stretches
    between are decoded together, padded to similar lengths.
    """
    n = len(emit)
    out = np.zeros(n, np.int8)
    ok = _allowed()
    spread = float(field.move[ok].max() - field.move[ok].min()) * 2
    sure = emit[:, 0] - emit[:, 1:].max(axis=1) > spread if n else np.zeros(0, bool)
    free = ~sure
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    begin = np.flatnonzero(free & (np.concatenate([[True], sure[:-1]]) | edge[:n]))
    end = np.flatnonzero(free & (np.concatenate([sure[1:], [True]]) | edge[1:])) + 1
    size = end - begin
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        width = int(size[order[at]])
        top = max(width + 2, width + width // 4)
        stop = min(int(np.searchsorted(size[order], top, "right")), at + max(1, (1 << 18) // top))
        some = order[at:stop]
        at = stop
        width = int(size[some].max())
        place = np.minimum(begin[some][:, None] + np.arange(width), n - 1)
        mask = np.arange(width) < size[some][:, None]
        score = field.move[0] + emit[place[:, 0]]
        back = np.zeros((len(some), width, STATES), np.int8)
        for j in range(1, width):
            options = score[:, :, None] + field.move
            best = options.argmax(axis=1)
            step = np.take_along_axis(options, best[:, None], 1)[:, 0] + emit[place[:, j]]
            live = mask[:, j][:, None]
            back[:, j] = np.where(live, best, np.arange(STATES))
            score = np.where(live, step, score)
        state = (score + field.move[:, 0]).argmax(axis=1)
        path = np.zeros((len(some), width), np.int8)
        for j in range(width - 1, -1, -1):
            path[:, j] = state
            state = back[np.arange(len(some)), j, state]
        out[place[mask]] = path[mask]
    return out


# ---------------------------------------------------------------- labelled table

def examples(count: int = 400, seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """A small labelled table made by rule: personal data in plain and in other
    spellings between invented words, and numbers that are none."""
    r = random.Random(seed)
    syllables = ["an", "der", "tion", "le", "ou", "st", "re", "con", "ei", "mo", "la", "th"]

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", ".", ","])

    def name() -> str:
        return "".join(r.choice(syllables) for _ in range(2))

    def number(n: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        head = number(15)
        return next(head + c for c in "0123456789" if luhn(head + c))

    def one(kind: int) -> list[str]:
        if kind == 0:
            host = f"{name()}{number(1)}.{name()}.com"
            return r.choice([[f"{name()}.{number(2)}@{host}"], [f"{name()}@{host}"], [name(), r.choice(["(at)", "[at]", "at"]), name(), r.choice(["dot", "(dot)", "[dot]"]), "com"],
                             [f"{name()}.{number(2)}", r.choice(["(at)", "[at]"]), host]])
        if kind == 1:
            return [".".join(str(r.randint(0, 255)) for _ in range(4))]
        if kind == 2:
            c = card()
            return r.choice([[c], [c[:4], c[4:8], c[8:12], c[12:]], ["-".join((c[:4], c[4:8], c[8:12], c[12:]))]])
        return r.choice([[f"+{number(2)}", number(3), number(7)], [f"+{number(1)}", f"({number(3)})", f"{number(3)}-{number(4)}"], [f"({number(3)})", f"{number(3)}-{number(4)}"],
                         [f"{number(3)}-{number(3)}-{number(4)}"], [f"+{number(11)}"], [f"+{number(1)}-{number(3)}-{number(3)}-{number(4)}"]])

    out = []
    for i in range(count):
        words, labels = [], []
        for _ in range(r.randint(1, 3)):
            some = [word() for _ in range(r.randint(2, 6))]
            words += some
            labels += [0] * len(some)
            if i % 3:
                kind = r.randrange(4)
                parts = one(kind)
                words += parts
                labels += [1 + 2 * kind] + [2 + 2 * kind] * (len(parts) - 1)
            else:
                words.append(r.choice([number(r.randint(1, 6)), f"{number(4)}-{number(2)}-{number(2)}", f"{number(2)}.{number(2)}", number(4) + ",", "at", f"{number(1)}.{number(1)}.{number(1)}", f"{word()}{number(2)}", f"{number(20)}"]))
                labels.append(0)
        words.append(word())
        labels.append(0)
        out.append((words, labels))
    return out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of text around pattern matches, and the beginnings of texts, with their labels."""
    for batch in batches:
        rows = []
        for text in batch.column(1):
            text = (text.as_py() or b"").decode("utf-8", "replace")
            found = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
            label = [0] * len(found)
            marked = []
            starts = np.array([a for a, _ in found] or [0])
            for kind, a, b in sorted(base_spans(text), key=lambda s: s[1]):
                i = max(0, int(np.searchsorted(starts, a, "right")) - 1)
                j = i
                while j < len(found) and found[j][0] < b:
                    label[j] = 1 + 2 * kind + (j > i)
                    j += 1
                marked.append(i)
            for i in [5, *marked[:8]]:
                lo, hi = max(0, i - 8), min(len(found), i + 12)
                while lo > 0 and label[lo] % 2 == 0 and label[lo]:
                    lo -= 1
                if hi > lo:
                    rows.append(([text[a:b] for a, b in found[lo:hi]], label[lo:hi]))
        yield pa.record_batch([pa.array([w for w, _ in rows], pa.list_(pa.string())), pa.array([y for _, y in rows], pa.list_(pa.int32()))], names=["words", "labels"])


def labelled(docs: DataFrame, documents: int = 300, seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """The labelled table: ``examples`` and stretches of at most ``documents`` texts
    (those with digits or an at sign of least hash of the id), labelled by the patterns."""
    chosen = docs.filter(F.col("text").cast("string").rlike("[0-9@]")).select("doc_id").distinct().orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(documents)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text").mapInArrow(_windows, "words array<string>, labels array<int>").toArrow().to_pylist()
    made = [(r["words"], r["labels"]) for r in rows if r["words"]]
    made.sort()
    return examples() + made


# ---------------------------------------------------------------- the operator

def _plausible(kind: int, s: str) -> bool:
    digits = "".join(_DIGITS.findall(s))
    if kind == 0:
        return bool(_AT.match(s))
    if kind == 1:
        return bool(_IP.fullmatch(s)) and _valid_ip(s)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1
    return 7 <= len(digits) <= 15 and not re.search(r"[A-Za-z]", s)


def _find(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = ids(batch)
            for lo, hi, data, off in slices(batch.column(1)):
                words = Words(data, off)
                state = viterbi(field, field.emissions(word_features(words)), words.first) if len(words) else np.zeros(0, np.int8)
                told = np.flatnonzero(state)
                has = np.zeros(hi - lo, bool)
                has[words.doc[told]] = True
                special = np.concatenate([[0], np.cumsum((data == 64) | ((data >= 48) & (data <= 57)))])
                has |= special[off[1:]] > special[off[:-1]]
                raw = data.tobytes()
                counts, base_digest, all_spans = np.zeros((hi - lo, 4), np.int64), [], []
                for i in range(hi - lo):
                    base, more = [], []
                    if has[i]:
                        bytes_ = raw[off[i]:off[i + 1]]
                        text = bytes_.decode("utf-8", "replace")
                        base = base_spans(text)
                        a, b = np.searchsorted(told, words.first[i:i + 2])
                        more = _added(text, bytes_, words, off[i], told[a:b], state, base)
                    for k, _, _ in base:
                        counts[i, k] += 1
                    base_digest.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                    all_spans.append(_listed(base + more))
                yield pa.record_batch([pa.array(doc[lo:hi]), *[pa.array(counts[:, k].copy()) for k in range(4)], pa.array(base_digest), pa.array(all_spans)],
                                      names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
    return run


def _added(text: str, raw: bytes, words: Words, begin: int, told: np.ndarray, state: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The field's spans that no pattern's span touches."""
    out: list[tuple[int, int, int]] = []
    taken = sorted((a, b) for _, a, b in base)
    i = 0
    while i < len(told):
        j = i + 1
        while j < len(told) and told[j] == told[j - 1] + 1 and state[told[j]] == state[told[i]] + 1 and state[told[i]] % 2:
            j += 1
        kind = (int(state[told[i]]) - 1) // 2
        a = len(raw[:words.start[told[i]] - begin].decode("utf-8", "replace"))
        s = raw[words.start[told[i]] - begin:words.end[told[j - 1]] - begin].decode("utf-8", "replace")
        i = j
        a += len(s) - len(s.lstrip("\"'<[{,;:" + ("(" if kind != 3 else "")))
        s = s.lstrip("\"'<[{,;:" + ("(" if kind != 3 else "")).rstrip("\"'>]},;:.!?" + (")" if s.count(")") > s.count("(") else ""))
        b = a + len(s)
        if s and _plausible(kind, s) and not any(x < b and a < y for x, y in taken):
            out.append((kind, a, b))
    return out


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def personal_spans(docs: DataFrame, table: list[tuple[list[str], list[int]]] | None = None) -> DataFrame:
    """``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (matches of the
    patterns), ``base_sha256`` (of their list) and ``spans`` (all, with the field's),
    lists by kind, then start; code points, end exclusive.

    ``table`` is the labelled table (words, states); by default ``labelled(docs)``.
    Spans of the field that touch a pattern's, or are no possible value of their
    kind (digits, check digit, parts), are not added.  Needs ``doc_id`` (integer) and
    ``text``; a null text is empty, rows without doc_id are left out, other columns
    are ignored, repeated rows give equal rows again, an empty table gives an
    empty result.
    """
    docs = texts(docs)
    field = train(table if table is not None else labelled(docs))
    return docs.mapInArrow(_find(field), "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
