"""Personal data: rule-based spans, and a character-level bidirectional LSTM with CRF transitions that adds to them.

The network is trained in numpy from labelled spans: those that the rules find, in the texts as they are and once more
written in ways that the rules miss (``disguised``), so that it learns what surrounds and makes up a span and not the rules
again. What it adds is checked by the digits it has (``_plausible``). Texts are cut into overlapping windows;
each window is tagged by Viterbi decoding, and the spans of all windows of a text are reconciled: parts that a window edge
cut are joined, and of spans that overlap the heaviest set without overlap stays. Every kind of span has a digit or an
``@``, so that a window without either is outside by definition and is not run through the network.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowest_keys, with_text_columns

KINDS = ("email", "ip", "card", "phone")
_TRIGGER = re.compile("[0-9@]")
_AT = re.compile("@")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number that starts in the middle of digits cannot match where its run's start does not, hence the look-behind.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
Span = tuple[int, int, int]  # start, kind, end


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Rule-based spans ``(start, kind number, end)`` in order: leftmost, non-overlapping in their kind, checked afterwards."""
    if not _TRIGGER.search(text):
        return []
    found: list[Span] = []
    last = 0
    for at in _AT.finditer(text):
        start = at.start()
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at.start() and (domain := _DOMAIN.match(text, at.end())):
            last = domain.end()
            found.append((start, 0, last))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_AT_SIGNS = (" @ ", "@ ", " @", " [@] ", "(@)", "@@")
_DOTS = {0: (".", ".", " . ", " dot ", "[.]"), 1: ("[.]", " . ", ". ", ",", "-", " dot ", "(.)")}
_GAPS = {2: (".", "/", "_", "  ", " - "), 3: ("/", "  ", " / ", "_")}


def disguised(text: str, spans: list[Span], salt: int = 0) -> tuple[str, list[Span]]:
    """The text with its rule-based spans written in ways that the rules miss, and where they are then.

    Addresses get spaces and brackets about their ``@``, dots are spelled out or bracketed, digits are grouped by other marks, a
    plus is parted from its number or becomes ``00``, and numbers stand twice in a row, which the rules take for one number.
    Choices are hashes of place and span, so that a repeated task gives the same. A span within another one is left out.
    """
    out, made, at, length = [], [], 0, 0
    for a, k, b in spans:
        if a < at:
            continue
        choice = zlib.crc32(f"{salt}:{a}:{text[a:b]}".encode("utf-8", "surrogatepass"))
        pick = lambda options, shift=0: options[(choice >> shift) % len(options)]  # noqa: B023, E731
        old, twice = text[a:b], False
        if k == 0:
            local, domain = old.split("@", 1)
            new = local + pick(_AT_SIGNS) + domain.replace(".", pick(_DOTS[0], 8))
        elif k == 1:
            new = old.replace(".", pick(_DOTS[1]))
        elif k == 2 and choice % 2:
            new, twice = old, True
        elif k == 2:
            digits = re.sub("[^0-9]", "", old)
            new = pick(_GAPS[2], 8).join(digits[i : i + 4] for i in range(0, len(digits), 4))
        else:
            gap = pick(_GAPS[3], 8)
            new = pick(("+ ", "00", "+", "(+)")) + re.sub(r"[\x20().-]+", gap, old[1:]).strip(gap)
        out.append(text[at:a])
        length += a - at
        for copy in (new, new) if twice else (new,):
            if made and twice and made[-1][2] == length:
                out.append(" ")
                length += 1
            out.append(copy)
            made.append((length, k, length + len(copy)))
            length += len(copy)
        at = b
    out.append(text[at:])
    return "".join(out), made


# --- the network -------------------------------------------------------------------------------------------------------
#: Characters: 95 printable ones, line ends and tabs, other letters, anything else; 0 is padding.
SYMBOLS, TAGS = 99, 1 + 2 * len(KINDS)  # tag 0 is outside; 1 + 2k begins and 2 + 2k continues kind k
_FORBIDDEN = np.array([[j >= 2 and j % 2 == 0 and i not in (j - 1, j) for j in range(TAGS)] for i in range(TAGS)])
_BARRED = np.where(_FORBIDDEN, -1e4, 0.0)
_BARRED_FIRST = np.array([-1e4 if j >= 2 and j % 2 == 0 else 0.0 for j in range(TAGS)])


def symbols_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    made = np.where((points >= 32) & (points < 127), points - 31, 98)
    made[(points == 10) | (points == 9) | (points == 13)] = 96
    for i in np.flatnonzero(points >= 128):
        if chr(points[i]).isalpha():
            made[i] = 97
    return made


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Tagger:
    """Parameters: input gates by symbol, recurrent gates and biases of both directions, output layer, transitions."""

    hidden: int = 16
    seed: int = 6
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if not self.p:
            rng, h = np.random.default_rng(self.seed), self.hidden
            self.p = {
                "x": rng.normal(0, 0.3, (2, SYMBOLS, 4 * h)), "h": rng.normal(0, 0.2, (2, h, 4 * h)),
                "o": rng.normal(0, 0.2, (2 * h, TAGS)), "ob": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS)),
            }
            self.p["x"][:, :, h : 2 * h] += 1.0  # forget gates start open

    def _run(self, symbols: np.ndarray, keep: bool = False):
        """Unary scores (windows, length, tags); with ``keep`` also what the backward pass needs."""
        n, length = symbols.shape
        h = self.hidden
        both = np.stack([symbols, symbols[:, ::-1]])
        gates_in = np.stack([self.p["x"][d][both[d]] for d in (0, 1)])
        state, cell = np.zeros((2, n, h)), np.zeros((2, n, h))
        outs, kept = np.zeros((2, n, length, h)), []
        for t in range(length):
            z = gates_in[:, :, t] + state @ self.p["h"]
            i, f, o = _sigmoid(z[..., :h]), _sigmoid(z[..., h : 2 * h]), _sigmoid(z[..., 2 * h : 3 * h])
            g = np.tanh(z[..., 3 * h :])
            new = f * cell + i * g
            squashed = np.tanh(new)
            if keep:
                kept.append((i, f, o, g, cell, squashed, state))
            cell, state = new, o * squashed
            outs[:, :, t] = state
        features = np.concatenate([outs[0], outs[1][:, ::-1]], axis=-1)
        return features @ self.p["o"] + self.p["ob"], (both, features, kept)

    def _transitions(self) -> np.ndarray:
        return self.p["t"] + _BARRED

    def gradients(self, symbols: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags, and its gradients."""
        n, length = symbols.shape
        h, trans = self.hidden, self._transitions()
        unary, (both, features, kept) = self._run(symbols, keep=True)
        soft = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
        alpha, beta = np.zeros_like(unary), np.zeros_like(unary)
        alpha[:, 0] = unary[:, 0] + _BARRED_FIRST
        for t in range(1, length):
            alpha[:, t] = unary[:, t] + soft(alpha[:, t - 1, :, None] + trans, 1)
        for t in range(length - 2, -1, -1):
            beta[:, t] = soft(trans + (unary[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        total = soft(alpha[:, -1], 1)
        marginal = np.exp(alpha + beta - total[:, None, None])
        pair = np.exp(alpha[:, :-1, :, None] + trans + (unary[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]).sum(axis=(0, 1))
        rows, steps = np.arange(n)[:, None], np.arange(length)
        gold = unary[rows, steps, tags].sum(axis=1) + self.p["t"][tags[:, :-1], tags[:, 1:]].sum(axis=1)
        loss = float((total - gold).mean())
        observed = np.zeros_like(pair)
        np.add.at(observed, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1.0)
        slope = marginal
        slope[rows, steps, tags] -= 1
        slope /= n
        made = {"t": (pair - observed) / n, "ob": slope.sum(axis=(0, 1)), "o": features.reshape(-1, 2 * h).T @ slope.reshape(-1, TAGS)}
        back = slope @ self.p["o"].T
        d_out = np.stack([back[..., :h], back[:, ::-1, h:]])
        d_gates = np.zeros((2, n, length, 4 * h))
        d_state, d_cell, d_h = np.zeros((2, n, h)), np.zeros((2, n, h)), np.zeros_like(self.p["h"])
        turned = self.p["h"].transpose(0, 2, 1)
        for t in range(length - 1, -1, -1):
            i, f, o, g, cell, squashed, state = kept[t]
            d_state = d_state + d_out[:, :, t]
            d_new = d_state * o * (1 - squashed**2) + d_cell
            dz = np.concatenate([d_new * g * i * (1 - i), d_new * cell * f * (1 - f), d_state * squashed * o * (1 - o), d_new * i * (1 - g**2)], axis=-1)
            d_gates[:, :, t] = dz
            d_h += state.transpose(0, 2, 1) @ dz
            d_state, d_cell = dz @ turned, d_new * f
        d_x = np.zeros_like(self.p["x"])
        for d in (0, 1):
            np.add.at(d_x[d], both[d].ravel(), d_gates[d].reshape(-1, 4 * h))
        return loss, made | {"h": d_h, "x": d_x}

    def train(self, symbols: np.ndarray, tags: np.ndarray, steps: int = 220, batch: int = 48, rate: float = 0.02) -> float:
        """Adam over random batches of windows; the last batches' mean loss."""
        rng = np.random.default_rng(self.seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in (0, 1))
        losses = []
        for step in range(1, steps + 1):
            chosen = rng.integers(0, len(symbols), batch)
            loss, made = self.gradients(symbols[chosen], tags[chosen])
            losses.append(loss)
            size = np.sqrt(sum(float((g**2).sum()) for g in made.values()))
            pace = rate * (1 - 0.9 * step / steps)
            for k, g in made.items():
                g = g * min(1.0, 5.0 / (size + 1e-12))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g**2
                self.p[k] = self.p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return float(np.mean(losses[-20:])) if losses else 0.0

    def decode(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of each window, and each position's margin of its tag over outside."""
        unary, _ = self._run(symbols)
        n, length, _ = unary.shape
        trans, best = self._transitions(), unary[:, 0] + _BARRED_FIRST
        came = np.zeros((n, length, TAGS), np.int8)
        for t in range(1, length):
            ways = best[:, :, None] + trans
            came[:, t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + unary[:, t]
        tags = np.zeros((n, length), np.int64)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = came[np.arange(n), t, tags[:, t]]
        margin = np.take_along_axis(unary, tags[:, :, None], 2)[..., 0] - unary[..., 0]
        return tags, margin


# --- windows and reconciliation ----------------------------------------------------------------------------------------
WINDOW, STRIDE, BATCH = 128, 64, 256


def windows_of(text: str) -> list[int]:
    """Starts of the overlapping windows that hold a digit or an ``@``."""
    starts, last = [], -1
    for m in _TRIGGER.finditer(text):
        first = max(0, m.start() - WINDOW + STRIDE) // STRIDE
        for w in range(max(first, last + 1), m.start() // STRIDE + 1):
            if w * STRIDE <= m.start() < w * STRIDE + WINDOW:
                starts.append(w * STRIDE)
                last = w
    return starts


def _cut(text: str, start: int) -> np.ndarray:
    made = np.zeros(WINDOW, np.int64)
    part = symbols_of(text[start : start + WINDOW])
    made[: len(part)] = part
    return made


def tags_of(text: str, start: int, spans: list[Span]) -> np.ndarray:
    """Tags of a window; of spans that overlap the earlier one counts."""
    made = np.zeros(WINDOW, np.int64)
    for a, k, b in spans:
        low, high = max(a - start, 0), min(b - start, WINDOW)
        if low < high and not made[low:high].any():
            made[low:high] = 2 + 2 * k
            made[low] = 1 + 2 * k
    return made


def _spans_in(tags: np.ndarray, margin: np.ndarray, start: int) -> list[tuple[int, int, int, float]]:
    out, i = [], 0
    while i < len(tags):
        if tags[i] and tags[i] % 2:
            j = i + 1
            while j < len(tags) and tags[j] == tags[i] + 1:
                j += 1
            out.append((start + i, int(tags[i] - 1) // 2, start + j, float(margin[i:j].sum())))
            i = j
        else:
            i += 1
    return out


def reconcile(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Spans of all windows of one text as a set without overlap.

    Spans of one kind that overlap or touch are one (a window edge cuts a span into parts); then the set of the largest
    total weight is taken, where a weight is the largest mean margin that a window gave times the length.
    """
    joined: list[list] = []
    for a, k, b, w in sorted(found, key=lambda s: (s[1], s[0], s[2])):
        if joined and joined[-1][1] == k and a <= joined[-1][2]:
            joined[-1][2] = max(b, joined[-1][2])
            joined[-1][3] = max(w / (b - a), joined[-1][3])
        else:
            joined.append([a, k, b, w / (b - a)])
    order = sorted(joined, key=lambda s: (s[2], s[0], s[1]))
    ends, best, take = [s[2] for s in order], [0.0], []
    for i, (a, _, b, w) in enumerate(order):
        low = int(np.searchsorted(ends[:i], a, side="right"))
        gain = best[low] + max(w, 0.0) * (b - a)
        take.append((gain > best[i], low))
        best.append(max(gain, best[i]))
    chosen, i = [], len(order)
    while i:
        taken, low = take[i - 1]
        if taken:
            chosen.append(tuple(order[i - 1]))
        i = low if taken else i - 1
    return chosen[::-1]


def _plausible(text: str, kind: int) -> bool:
    """What a span must have to be added: the digits of its kind, checked as the rules check theirs, or the parts of an address."""
    digits = "".join(c for c in text if "0" <= c <= "9")
    if len(text) > WINDOW:
        return False
    if kind == 0:
        return "@" in text[1:-1] and ("." in text or " dot " in text)
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if any(c.isalpha() for c in text):
        return False
    return 14 <= len(digits) <= 19 and _luhn(digits) if kind == 2 else 10 <= len(digits) <= 15


class Finder:
    """Rule-based spans, and those that a trained tagger adds."""

    def __init__(self, tagger: Tagger | None, margin: float = 0.2):
        self.tagger, self.margin = tagger, margin

    def find(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """Base spans and all spans of each text."""
        base = [base_spans(t) for t in texts]
        places = [(i, w) for i, t in enumerate(texts) for w in windows_of(t)] if self.tagger else []
        proposed: dict[int, list] = {}
        for at in range(0, len(places), BATCH):
            part = places[at : at + BATCH]
            tags, margin = self.tagger.decode(np.stack([_cut(texts[i], w) for i, w in part]))
            for (i, w), t, m in zip(part, tags, margin, strict=True):
                if t.any():
                    proposed.setdefault(i, []).extend(_spans_in(t, m, w))
        out = []
        for i, (text, own) in enumerate(zip(texts, base, strict=True)):
            more = []
            for a, k, b, w in reconcile(proposed.get(i, [])):
                b = min(b, len(text))
                if w >= self.margin and _plausible(text[a:b], k) and not any(x < b and a < y for x, _, y in own):
                    more.append((a, k, b))
            out.append((own, sorted(own + more)))
        return out


def training_windows(text: str, most: int = 4) -> list[tuple[np.ndarray, np.ndarray]]:
    """Symbols and tags of at most ``most`` windows of a text as it is and as many of the disguised one, windows with spans first."""
    out = []
    own = base_spans(text)
    for t, spans in ((text, own), disguised(text, own)) if own else ((text, own),):
        every = windows_of(t)
        near = [w for w in every if any(a < w + WINDOW and w < b for a, _, b in spans)]
        out += [(_cut(t, w), tags_of(t, w, spans)) for w in (near or every)[:most]]
    return out


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", most: int = 3000, windows: int = 4, **training) -> Tagger | None:
    """Tagger trained on windows of texts with a digit or an ``@``, taken by a hash of the key from all texts.

    At most ``most`` such texts are used, out of the 40 times as many of the lowest hashes; rows with a null key teach nothing.
    Each gives at most ``windows`` windows, and as many with its spans disguised. Without any labelled span there is no tagger, and only
    rules are used.
    """
    rows = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).where(F.col("t").rlike("[0-9@]"))
    chosen_keys = F.broadcast(lowest_keys(rows, "k", most, df.count(), margin=40))  # at most ``most`` keys

    def cut(texts: list[str]):
        out = []
        for t in texts:
            made = training_windows(t, windows)
            out.append("\n".join(" ".join(map(str, [*symbols, *tags])) for symbols, tags in made))
        return [out]

    chosen = with_text_columns(rows.join(chosen_keys, "k"), "t", {"windows": "string"}, lambda: cut).select("windows").collect()
    # Sorted, so that the order in which tasks end does not change the model.
    lines = [np.array(x.split(), np.int64) for x in sorted(x for r in chosen for x in r["windows"].split("\n") if x)]
    if not lines or not any(x[WINDOW:].any() for x in lines):
        return None
    made = np.stack(lines)
    tagger = Tagger()
    tagger.train(made[:, :WINDOW], made[:, WINDOW:], **training)
    return tagger


def personal_data(df: DataFrame, tagger: Tagger | None, text: str = "text", margin: float = 0.2) -> DataFrame:
    """``df`` with ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (rule-based spans), ``base_sha256`` and ``spans``.

    ``spans`` has rule-based and added spans as ``kind:start:end`` in code points, by start and then kind; ``base_sha256``
    is the digest of the rule-based ones written alike. Null and empty texts have none.
    """

    def make():
        finder = Finder(tagger, margin)

        def work(texts: list[str]):
            found = finder.find(texts)
            counts = [[sum(k == kind for _, k, _ in own) for own, _ in found] for kind in range(len(KINDS))]
            return [*counts, [hashlib.sha256(told(own).encode()).hexdigest() for own, _ in found], [told(every) for _, every in found]]

        return work

    return with_text_columns(df, text, {f"n_{k}": "bigint" for k in KINDS} | {"base_sha256": "string", "spans": "string"}, make)


def redacted(df: DataFrame, tagger: Tagger | None, text: str = "text", margin: float = 0.2) -> DataFrame:
    """``df`` with every span in its text replaced by its kind in brackets; spans that overlap are replaced as one.

    A null text stays null.
    """

    def make():
        finder = Finder(tagger, margin)

        def work(texts: list[str]):
            out = []
            for t, (_, every) in zip(texts, finder.find(texts), strict=True):
                parts, at = [], 0
                for a, k, b in every:
                    if a >= at:
                        parts += [t[at:a], f"[{KINDS[k].upper()}]"]
                    at = max(at, b)
                out.append("".join(parts) + t[at:])
            return [out]

        return work

    made = with_text_columns(df, text, {"__clean": "string"}, make)
    clean = F.when(F.col(f"`{text}`").isNotNull(), F.col("__clean")).alias(text)
    return made.select(*(clean if c == text else F.col(f"`{c}`") for c in df.columns))
