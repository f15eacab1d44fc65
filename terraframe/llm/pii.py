"""Personal data by rules and by a character-level bidirectional LSTM with a CRF.

The rules find base spans. The network adds spans that the rules leave out: secrets (access tokens, keys,
passwords), for which there is no rule, phone numbers without a country code, cards in other groupings,
addresses with letters beyond ASCII or written-out signs, IPv6. It is trained in numpy on labelled spans that a
seeded generator writes into invented lines, once in a driver process, and is broadcast (its size is fixed by
``HIDDEN`` and ``EMBED``).

A text is cut into cores of ``CORE`` characters. The window of a core has ``SIDE`` more characters on both sides;
each window is decoded by Viterbi, and of its tags those of its core are kept. The cores' tags, one after another,
are the tags of the text, so a span may be of any length: windows that begin inside a span are taught to say so.
Where neighbouring cores disagree, a tag that can't go on from the one before begins a new span. A span is added if
its path scores at least ``MARGIN`` more than one that leaves it out.

A core is run if its window meets a blank-free run of characters with a digit, ``@`` or a written-out ``(at)`` in
it; spans further from one are not looked for. What follows the network are exact checks only: a card's digits
pass Luhn, an address of the network is one, a phone number has 7 to 15 digits, a mail address has its sign and no
blank; and signs at the ends that are no part of a number are cut. Base spans stay. An added span that overlaps some is dropped, unless they
are of its kind and inside it (the whole of an address of which the rules see the end).

Defined results
    * A null or empty text has no span. Repeated rows are judged alike. Offsets are code points, end exclusive.
    * Base spans of different kinds may overlap; added ones never overlap each other.
    * Texts of any length are cut into windows, never shortened; memory and time grow in proportion to them.
    * Columns of the input pass through; names that the operator adds win. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import python_ready, table

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the network: those of the rules, and secrets.
LEARNED = (*KINDS, "secret")
TAGS = ("O", *(f"{p}-{k}" for k in LEARNED for p in "BI"))
CORE, SIDE = 48, 24
WINDOW = CORE + 2 * SIDE
#: Windows to learn from are shorter: a pass takes as long as its windows have characters, and that much context is enough.
TAUGHT = 64
EMBED, HIDDEN, SYMBOLS = 12, 20, 131
PADDING = SYMBOLS - 1
BATCH = 1024
MARGIN = 2.0

_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _ips(text: str) -> Iterator[tuple[int, int]]:
    groups = [m.span() for m in _DIGITS.finditer(text)]
    k = 0
    while k + 3 < len(groups):
        four = groups[k : k + 4]
        if all(b[0] == a[1] + 1 and text[a[1]] == "." for a, b in zip(four, four[1:])):
            if all(len(part) <= 3 and int(part or 0) <= 255 for part in (text[a:b].lstrip("0") for a, b in four)):
                yield four[0][0], four[3][1]
            k += 4
        else:
            k += 1


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        for run in _RUN.finditer(text):
            if "@" in run[0]:
                out["email"] += [(run.start() + m.start(), run.start() + m.end()) for m in _EMAIL.finditer(run[0])]
    if _DIGITS.search(text):
        out["ip"] = list(_ips(text))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]
    return out


# The network.


def encode(text: str) -> np.ndarray:
    """Symbols: ASCII as it is, then letters beyond it, other characters beyond it, and 130 for padding."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if points.size and points.max() >= 128:
        return np.array([c if c < 128 else 128 + (not chr(c).isalpha()) for c in points.tolist()], np.int64)
    return points.astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Parameters by name; the two directions are stacked on the first axis."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        w = lambda *s: rng.normal(0, 1 / np.sqrt(s[-2]), s)
        self.p = {"e": rng.normal(0, 0.5, (SYMBOLS, EMBED)), "x": w(2, EMBED, 4 * HIDDEN), "h": w(2, HIDDEN, 4 * HIDDEN), "b": np.zeros((2, 1, 4 * HIDDEN)), "o": w(2 * HIDDEN, len(TAGS)), "c": np.zeros(len(TAGS)), "t": np.zeros((len(TAGS), len(TAGS)))}
        self.p["b"][:, :, HIDDEN : 2 * HIDDEN] = 1  # remember at first
        self.ban = np.zeros((len(TAGS), len(TAGS)))
        for j, to in enumerate(TAGS):
            if to[0] == "I":
                for i, of in enumerate(TAGS):
                    if of[2:] != to[2:]:
                        self.ban[i, j] = -1e4

    def shrink(self) -> Network:
        """Single precision, for use."""
        self.p, self.ban = {k: v.astype(np.float32) for k, v in self.p.items()}, self.ban.astype(np.float32)
        return self

    def run(self, ids: np.ndarray, keep: bool = False):
        """Emissions (n, length, tags) of windows of symbols; with keep also what the gradient needs."""
        p, (n, length) = self.p, ids.shape
        both = np.stack([ids, ids[:, ::-1]])  # direction, window, step
        gates = np.stack([(p["e"] @ p["x"][d] + p["b"][d])[both[d]] for d in (0, 1)])
        h, c = (np.zeros((2, n, HIDDEN), p["h"].dtype) for _ in range(2))
        hs, held = np.empty((length, 2, n, HIDDEN), h.dtype), []
        for s in range(length):
            a = gates[:, :, s] + h @ p["h"]
            ifo, g = _sigmoid(a[..., : 3 * HIDDEN]), np.tanh(a[..., 3 * HIDDEN :])
            i, f, o = ifo[..., :HIDDEN], ifo[..., HIDDEN : 2 * HIDDEN], ifo[..., 2 * HIDDEN :]
            before = c
            c = f * c + i * g
            tc = np.tanh(c)
            if keep:
                held.append((i, f, o, g, before, tc, h))
            h = o * tc
            hs[s] = h
        joint = np.concatenate([hs[:, 0], hs[::-1, 1]], -1).transpose(1, 0, 2)
        emissions = joint @ p["o"] + p["c"]
        return (emissions, joint, held, both) if keep else emissions

    def gradient(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the CRF, and its gradient."""
        p, (n, length) = self.p, ids.shape
        em, joint, held, both = self.run(ids, True)
        tr = p["t"] + self.ban
        moves = np.exp(tr)
        alpha, beta = np.empty_like(em), np.zeros_like(em)

        def onward(x: np.ndarray, by: np.ndarray) -> np.ndarray:
            m = x.max(1, keepdims=True)
            return np.log(np.maximum(np.exp(x - m) @ by, 1e-35)) + m

        alpha[:, 0] = em[:, 0]
        for s in range(1, length):
            alpha[:, s] = onward(alpha[:, s - 1], moves) + em[:, s]
        for s in range(length - 2, -1, -1):
            beta[:, s] = onward(em[:, s + 1] + beta[:, s + 1], moves.T)
        z = onward(alpha[:, -1], np.ones((len(TAGS), 1), em.dtype))[:, 0]
        at = np.arange(n)[:, None], np.arange(length)[None, :], tags
        gold = em[at].sum(1) + tr[tags[:, :-1], tags[:, 1:]].sum(1)
        d_em = np.exp(alpha + beta - z[:, None, None])
        d_em[at] -= 1
        # exp(alpha + transition + emission + beta - z), summed over places; the highest alpha of a place is taken out of both factors.
        top = alpha[:, :-1].max(2, keepdims=True)
        left, right = np.exp(alpha[:, :-1] - top), np.exp(np.minimum(em[:, 1:] + beta[:, 1:] + top - z[:, None, None], 80))
        pair = moves * (left.reshape(-1, len(TAGS)).T @ right.reshape(-1, len(TAGS)))
        np.subtract.at(pair, (tags[:, :-1], tags[:, 1:]), 1)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["t"], g["c"] = pair / n, d_em.sum((0, 1)) / n
        g["o"] = joint.reshape(-1, 2 * HIDDEN).T @ d_em.reshape(-1, len(TAGS)) / n
        d_joint = d_em @ p["o"].T / n
        dh, dc = (np.zeros((2, n, HIDDEN), em.dtype) for _ in range(2))
        d_gates = np.empty((length, 2, n, 4 * HIDDEN), em.dtype)
        for s in range(length - 1, -1, -1):
            i, f, o, gg, before, tc, h = held[s]
            dh = dh + np.stack([d_joint[:, s, :HIDDEN], d_joint[:, length - 1 - s, HIDDEN:]])
            dc = dc + dh * o * (1 - tc * tc)
            da = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], -1)
            g["h"] += h.transpose(0, 2, 1) @ da
            d_gates[s] = da
            dh, dc = da @ p["h"].transpose(0, 2, 1), dc * f
        for d in (0, 1):
            order = np.argsort(both[d].T, axis=None, kind="stable")
            symbols, first = np.unique(both[d].T.reshape(-1)[order], return_index=True)
            by_symbol = np.zeros((SYMBOLS, 4 * HIDDEN), em.dtype)
            by_symbol[symbols] = np.add.reduceat(d_gates[:, d].reshape(-1, 4 * HIDDEN)[order], first)
            g["x"][d] = p["e"].T @ by_symbol
            g["b"][d] = by_symbol.sum(0)
            g["e"] += by_symbol @ p["x"][d].T
        return float((z - gold).mean()), g

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of each window, and the emission of each best tag over that of O."""
        em = self.run(ids)
        tr, (n, length, _) = self.p["t"] + self.ban, em.shape
        score, back = em[:, 0], np.empty((length, n, len(TAGS)), np.int8)
        for s in range(1, length):
            both = score[:, :, None] + tr
            back[s] = both.argmax(1)
            score = both.max(1) + em[:, s]
        tags = np.empty((n, length), np.int64)
        tags[:, -1] = score.argmax(1)
        for s in range(length - 1, 0, -1):
            tags[:, s - 1] = back[s][np.arange(n), tags[:, s]]
        lead = np.take_along_axis(em, tags[:, :, None], 2)[:, :, 0] - em[:, :, 0]
        return tags, lead


# Labelled spans to learn from.

_SYLLABLES = "the and tion er in re on at is of le la de que ment ein sch ung der die os ar ció ñ é ü ß ou va ko mi lu pra з на ст の 中".split()
_LATIN = _SYLLABLES[:30]


def _pick(rng, options):
    return options[int(rng.integers(0, len(options)))]


def _word(rng, syllables=_SYLLABLES) -> str:
    w = "".join(_pick(rng, syllables) for _ in range(int(rng.integers(1, 5))))
    return w.capitalize() if rng.random() < 0.15 else w.upper() if rng.random() < 0.08 else w


def _digits(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, int(n))))


def _chars(rng, letters: str, n: int) -> str:
    return "".join(letters[k] for k in rng.integers(0, len(letters), int(n)))


_HEX, _KEY = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _card_number(rng, n: int) -> str:
    body = _pick(rng, "3456") + (_digits(rng, n - 2) if rng.random() < 0.85 else _digits(rng, 1) * (n - 2))
    return next(body + c for c in "0123456789" if luhn(body + c))


def _email(rng) -> str:
    beyond = rng.random() < 0.5
    part = lambda: _word(rng, _SYLLABLES if beyond else _LATIN[:22]).lower()
    name = _pick(rng, ["", ".", "_", "-"]).join(part() for _ in range(int(rng.integers(1, 3)))) + (_digits(rng, rng.integers(1, 4)) if rng.random() < 0.4 else "")
    if rng.random() < 0.05:
        name = "".join(part() for _ in range(int(rng.integers(8, 30))))
    host = part() + _digits(rng, rng.integers(0, 2)) + ("." + part() if rng.random() < 0.3 else "") + "." + _pick(rng, ["com", "org", "net", "de", "fr", "es", "example.com", "co.uk"])
    if rng.random() < 0.08:
        sign, dot = _pick(rng, [("[at]", "[dot]"), ("(at)", "(dot)"), ("(at)", "."), ("[at]", ".")])
        return name + sign + host.replace(".", dot)
    return f"{name}@{host}"


def _ip(rng) -> str:
    if rng.random() < 0.55:
        return ".".join(str(x) for x in rng.integers(0, 256, 4))
    groups = [_chars(rng, _HEX, rng.integers(1, 5)) for _ in range(8)]
    if rng.random() < 0.5:
        lo = int(rng.integers(1, 5))
        return ":".join(groups[:lo]) + "::" + ":".join(groups[lo + 3 :][: int(rng.integers(1, 4))])
    return ":".join(groups)


def _card(rng) -> str:
    n = _pick(rng, [16, 16, 16, 16, 15, 13, 19])
    number, sep = _card_number(rng, n), _pick(rng, ["", "", " ", "-", ".", "/", "_", "  "])
    if n == 15:
        return sep.join((number[:4], number[4:10], number[10:]))
    return sep.join(number[k : k + 4] for k in range(0, n, 4))


def _phone(rng) -> str:
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    two = lambda n: _pick(rng, [" ", ".", "-"]).join(_digits(rng, 2) for _ in range(n))
    sep = _pick(rng, ["-", "-", ".", " ", "/"])
    forms = [
        f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}){sep}{b}{sep}{c}", f"{a}{sep}{b}{sep}{c}", f"{a}-{b}-{c}", f"1-{a}-{b}-{c}", f"1 ({a}) {b}-{c}", f"{b}-{c}",
        f"+1 ({a}) {b}-{c}", f"+49 {a} {b}{c}", f"+{a[:2]}{sep}{b}{sep}{c}", f"00{a[:2]} {a} {b}{c}", f"0{a}{_pick(rng, [' ', '/', '-', ' / '])}{b}{c}", f"0{a[:2]} {two(4)}", f"0{a[0]} {two(4)}", f"(0{a}) {b}{c}", f"+33 {a[0]} {two(4)}", f"0{a} {b} {c}",
    ]
    number = _pick(rng, forms)
    return number + (f" ext. {_digits(rng, 3)}" if rng.random() < 0.04 else "")


_NAMES = ["token", "api_key", "apikey", "secret", "password", "passwd", "pwd", "access_key", "auth", "bearer", "client_secret", "key", "private_key", "credential"]


def _secret(rng) -> tuple[str, str, str]:
    """What stands before, the secret, and what stands behind."""
    k = rng.integers(0, 10)
    if k < 4:
        value = _chars(rng, _HEX, _pick(rng, [32, 40, 40, 40, 64, 24]))
    elif k < 6:
        value = _chars(rng, _KEY, rng.integers(20, 49))
    elif k == 6:
        value = _pick(rng, ["sk_live_", "sk-", "ghp_", "AKIA", "xoxb-", "pk_test_", "glpat-"]) + _chars(rng, _KEY, rng.integers(16, 40))
    elif k == 7:
        value = ".".join(_chars(rng, _KEY + "-_", rng.integers(15, 60)) for _ in range(3))
    elif k == 8:
        value = _chars(rng, _KEY + "!$%&*#-_", rng.integers(8, 17)) + _digits(rng, rng.integers(1, 4))
    else:
        value = "-".join(_chars(rng, _HEX, n) for n in (8, 4, 4, 4, 12))
    if not re.search("[0-9]", value):
        value += _digits(rng, 2)
    if rng.random() < 0.1:
        value = value.upper()
    name = _pick(rng, _NAMES)
    name = name.upper() if rng.random() < 0.2 else name.capitalize() if rng.random() < 0.1 else name
    quote = _pick(rng, ['"', '"', '"', "'", ""])
    return name + _pick(rng, [" = ", " = ", "=", ": ", " is ", " := ", '": ']) + quote, value, quote


def _other(rng) -> str:
    """What looks like personal data or a secret and is none."""
    k = rng.integers(0, 19)
    if k == 0:
        return f"{rng.integers(1900, 2031)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}"
    if k == 1:
        return f"{rng.integers(1, 13):02d}/{rng.integers(1, 29):02d}/{rng.integers(1900, 2031)}"
    if k == 2:
        return _digits(rng, rng.integers(1, 7))
    if k == 3:
        return f"{rng.integers(0, 24):02d}:{rng.integers(0, 60):02d}" + _pick(rng, ["", f":{rng.integers(0, 60):02d}"])
    if k == 4:
        return _pick(rng, ["v", "version ", "Version ", ""]) + f"{rng.integers(0, 10)}.{rng.integers(0, 30)}" + _pick(rng, ["", f".{rng.integers(0, 30)}"])
    if k == 5:
        return f"${rng.integers(1, 999)},{_digits(rng, 3)}.{_digits(rng, 2)}"
    if k == 6:
        return f"{rng.integers(1, 100)} | {rng.integers(1, 1000)} | {_digits(rng, 4)}"
    if k == 7:
        return f"{rng.integers(1, 32)}.{rng.integers(1, 13)}.{rng.integers(1900, 2031)}"
    if k == 8:
        return f"@{_word(rng)}"
    if k == 9:
        return f"{_pick(rng, _NAMES)} {_word(rng)}"
    if k == 10:
        return f"https://{_word(rng, _LATIN).lower()}.{_pick(rng, ['com', 'org', 'de'])}/{_word(rng, _LATIN).lower()}/{_digits(rng, rng.integers(1, 6))}.html"
    if k == 11:
        return f"{rng.integers(1900, 2000)}-{rng.integers(2000, 2031)}" if rng.random() < 0.5 else f"pp. {rng.integers(1, 300)}-{rng.integers(300, 999)}"
    if k == 12:
        return f"{_word(rng, _LATIN)}{_digits(rng, rng.integers(1, 4))}"
    if k == 13:
        return f"ISBN 978-{_digits(rng, 1)}-{_digits(rng, 4)}-{_digits(rng, 4)}-{_digits(rng, 1)}"
    if k == 14:
        return f"{rng.integers(0, 100)}.{_digits(rng, rng.integers(1, 7))}" + _pick(rng, ["%", "", " km", "e-5"])
    if k == 15:
        return f"{_digits(rng, 1)},{_digits(rng, 3)},{_digits(rng, 3)}" if rng.random() < 0.5 else f"{rng.integers(1, 999)} 000 000"
    if k == 16:
        return f"{_word(rng)} @ {_digits(rng, 2)}"
    if k == 17:
        return f"§ {rng.integers(1, 999)} ({rng.integers(1, 9)}) {_word(rng)}"
    return f"No. {_digits(rng, rng.integers(1, 9))}" if rng.random() < 0.5 else f"[{rng.integers(1, 99)}]"


def example(rng) -> tuple[str, list[tuple[str, int, int]]]:
    """A line with its labelled spans."""
    text, spans = "", []
    often, ends = rng.random() * 0.25, [" ", " ", " ", " ", " ", ", ", ". ", "\n", "!! ", " | ", "### ", "; ", " or ", " and ", " - "]
    while len(text) < 2 * WINDOW:
        u = rng.random()
        if u < 0.04 + often:
            kind = _pick(rng, LEARNED)
            before, value, behind = _secret(rng) if kind == "secret" else (_pick(rng, ["", "", "", "tel: ", "<", "(", "= "]), {"email": _email, "ip": _ip, "card": _card, "phone": _phone}[kind](rng), "")
            spans.append((kind, len(text) + len(before), len(text) + len(before) + len(value)))
            text += before + value + behind + {"<": ">", "(": ")"}.get(before, "")
        else:
            text += _other(rng) if u < 0.18 + 2 * often else _word(rng)
        text += _pick(rng, ends)
    return text, spans


def _window(rng, size: int = TAUGHT) -> tuple[np.ndarray, np.ndarray]:
    """``size`` characters of a line; beyond the line there is padding, and a span that began before the window goes on in it."""
    text, spans = example(rng)
    tags = np.zeros(len(text), np.int64)
    for kind, a, b in spans:
        tags[a : a + 1] = TAGS.index(f"B-{kind}")
        tags[a + 1 : b] = TAGS.index(f"I-{kind}")
    ids, tags = np.pad(encode(text), SIDE, constant_values=PADDING), np.pad(tags, SIDE)
    lo = int(rng.integers(0, len(ids) - size + 1)) if rng.random() < 0.9 else _pick(rng, [0, len(ids) - size])
    return ids[lo : lo + size], tags[lo : lo + size]


@functools.lru_cache(maxsize=2)
def trained(examples: int = 6144, epochs: int = 5, batch: int = 32, seed: int = 11) -> Network:
    """The network after training with Adam; the same for the same arguments."""
    rng = np.random.default_rng(seed)
    data = [_window(rng) for _ in range(examples)]
    x, y = np.stack([a for a, _ in data]), np.stack([b for _, b in data])
    net = Network()
    net.shrink()
    m, v = ({k: np.zeros_like(p) for k, p in net.p.items()} for _ in range(2))
    step, steps = 0, epochs * (examples // batch)
    for _ in range(epochs):
        order = rng.permutation(examples)
        for lo in range(0, examples - batch + 1, batch):
            at = order[lo : lo + batch]
            _, g = net.gradient(x[at], y[at])
            size = float(np.sqrt(sum(float((d * d).sum()) for d in g.values())))
            step += 1
            rate = 0.02 * (1 - 0.95 * step / steps)
            for k, d in g.items():
                d = d.astype(np.float32) * np.float32(min(1, 5 / size))
                m[k] = np.float32(0.9) * m[k] + np.float32(0.1) * d
                v[k] = np.float32(0.99) * v[k] + np.float32(0.01) * d * d
                net.p[k] -= np.float32(rate) * (m[k] / np.float32(1 - 0.9**step)) / (np.sqrt(v[k] / np.float32(1 - 0.99**step)) + np.float32(1e-8))
    return net


# Use.

_TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]")
_WRITTEN_AT = re.compile(r"[(\[]at[)\]]")


def trimmed(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    """Numbers without what stands at their ends and is no part of one; others without blanks there."""
    front, back = ("+(0123456789", "0123456789") if kind in ("card", "phone") else (None, None)
    while a < b and (text[a] not in front if front else text[a].isspace()):
        a += 1
    while a < b and (text[b - 1] not in back if back else text[b - 1].isspace()):
        b -= 1
    return a, b


def valid(kind: str, text: str) -> bool:
    """What can be checked exactly of an added span."""
    digits = "".join(_DIGITS.findall(text))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "ip":
        try:
            ipaddress.ip_address(text)
        except ValueError:
            return False
    if kind == "email":
        return ("@" in text or _WRITTEN_AT.search(text) is not None) and not any(c.isspace() for c in text)
    return len(text) > 0


class _Text:
    """A text whose windows are being decoded."""

    def __init__(self, text: str):
        self.text, self.base, self.cores = text, base_spans(text), []

    def windows(self) -> Iterator[tuple[int, np.ndarray]]:
        """The numbers of the cores to run, ascending, with their windows."""
        text = self.text
        if not _TRIGGER.search(text):
            return
        done = -1
        for m in re.finditer(r"\S+", text):
            if _TRIGGER.search(m[0]):
                for k in range(max(done + 1, (m.start() - SIDE) // CORE), (m.end() - 1 + SIDE) // CORE + 1):
                    lo = k * CORE - SIDE
                    ids = encode(text[max(0, lo) : lo + WINDOW])
                    front = max(0, -lo)
                    if k * CORE < len(text):
                        yield k, np.pad(ids, (front, WINDOW - front - len(ids)), constant_values=PADDING)
                    done = k

    def take(self, core: int, tags: np.ndarray, lead: np.ndarray) -> None:
        tags, lead = tags[SIDE : SIDE + CORE], lead[SIDE : SIDE + CORE]
        if tags.any():
            self.cores.append((core, tags.astype(np.int8), lead.astype(np.float32)))

    def _runs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Tags and leads of consecutive cores, with an O before and behind."""
        lo = 0
        for hi in range(1, len(self.cores) + 1):
            if hi == len(self.cores) or self.cores[hi][0] != self.cores[hi - 1][0] + 1:
                own = self.cores[lo:hi]
                yield own[0][0] * CORE, np.concatenate([[0], *(t for _, t, _ in own), [0]]).astype(np.intp), np.concatenate([[0], *(x for _, _, x in own), [0]]).astype(np.float64)
                lo = hi

    def added(self, steps: np.ndarray) -> list[tuple[str, int, int]]:
        """The network's spans beside the base ones, in order."""
        taken = sorted((a, b, k) for k, spans in self.base.items() for a, b in spans)
        ends = np.maximum.accumulate([b for _, b, _ in taken]) if taken else np.empty(0, np.int64)
        starts = np.array([a for a, _, _ in taken], np.int64)
        out = []
        for at, tags, lead in self._runs():
            kinds = (tags + 1) // 2
            begin = (kinds > 0) & ((tags % 2 == 1) | (np.concatenate(([0], kinds[:-1])) != kinds))
            first = np.flatnonzero(begin)
            stop = np.flatnonzero(begin | (kinds == 0))
            last = stop[np.searchsorted(stop, first, "right")]
            moves = np.concatenate(([0.0], np.cumsum(steps[tags[:-1], tags[1:]])))  # moves[i]: of all steps up to position i
            sums = np.concatenate(([0.0], np.cumsum(lead)))
            plain = steps[tags[first - 1], 0] + (last - first - 1) * steps[0, 0] + steps[0, tags[last]]
            score = sums[last] - sums[first] + moves[last] - moves[first - 1] - plain
            for a, b, kind, x in zip((first + at - 1).tolist(), (last + at - 1).tolist(), (kinds[first] - 1).tolist(), score.tolist()):
                a, b = trimmed(LEARNED[kind], self.text, a, min(b, len(self.text)))
                if x < MARGIN or not valid(LEARNED[kind], self.text[a:b]):
                    continue
                lo, hi = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
                own = taken[lo:hi]
                if all(k == LEARNED[kind] and a <= s and e <= b and (a, b) != (s, e) for s, e, k in own if e > a):
                    out.append((LEARNED[kind], a, b))
        return out


def _joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in LEARNED for a, b in sorted(spans.get(k, ())))


def find(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """The documents with n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added and n_secret (of the
    network), n_spans (all, of any kind: 0 where nothing personal or secret was found)."""
    spark = docs.sparkSession
    python_ready(spark)
    added = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_secret", "n_spans"]
    kept = [c for c in docs.columns if c not in added and (keep_text or c != text_col)]
    shared = spark.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            rows, waiting, at, ids = [], [], [], []

            def decode():
                tags, lead = net.decode(np.stack(ids))
                for text, a, t, s in zip(waiting, at, tags, lead):
                    text.take(a, t, s)
                waiting.clear(), at.clear(), ids.clear()

            for text in batch.column(text_col):
                row = _Text(text.as_py() or "")
                rows.append(row)
                for a, window in row.windows():
                    waiting.append(row), at.append(a), ids.append(window)
                    if len(ids) == BATCH:
                        decode()
            if ids:
                decode()
            steps = (net.p["t"] + net.ban).astype(np.float64)
            more = [row.added(steps) for row in rows]
            counts = [pa.array([len(row.base[k]) for row in rows], pa.int64()) for k in KINDS]
            base = [hashlib.sha256(_joined(row.base).encode()).hexdigest() for row in rows]
            spans = [_joined({k: row.base.get(k, []) + [(a, b) for kind, a, b in new if kind == k] for k in LEARNED}) for row, new in zip(rows, more)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *counts, pa.array(base, pa.string()), pa.array(spans, pa.string()), pa.array(list(map(len, more)), pa.int64()), pa.array([sum(k == "secret" for k, _, _ in new) for new in more], pa.int64()),
                 pa.array([sum(map(len, row.base.values())) + len(new) for row, new in zip(rows, more)], pa.int64())], names=[*kept, *added]
            )

    schema = T.StructType([docs.schema[c] for c in kept])
    for c in added:
        schema = schema.add(c, "long" if c.startswith("n_") else "string")
    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
