"""Secret scans: fixed patterns, and probabilistic automata of credential formats inferred by state merging.

For each label of a small set of labelled credentials, a prefix tree of their symbols is built and its
statistically compatible states are merged (Carrasco and Oncina's ALERGIA: two states are compatible if their
relative frequencies of ending and of each next symbol differ by less than a Hoeffding bound, and so do those
of the states that they lead to).  An automaton of background tokens is inferred the same way.  Every candidate,
a run of at least ``CANDIDATE`` credential characters, is scored by the log likelihood ratio a
symbol of its best format against the background; those from the threshold on are spans of kind ``format``
unless they overlap a base span.

Labelled rows: ``labelled_examples`` generates ``PER_LABEL`` credentials of each public format from a fixed
seed, the bound of the training set; ``infer`` takes any other labelled rows.  The threshold is calibrated on rows of another
seed: half way between the background's highest score and the score that ``MISSED`` of the credentials stay below.

Scale: one pass over the texts without a shuffle; the model is a few thousand numbers.

Defined cases: a null text is an empty one and has no spans; equal rows get equal results; matches that fail
the length rule are dropped and not tried again from inside; texts of any length are scanned whole; of other columns than doc_id and
text none is read, whatever it is called.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_batches, texts

#: Credentials generated for each label, background tokens twenty times as many.
PER_LABEL = 240
#: Shortest candidate, in characters, and the shares of credentials and of background that calibration may take for the other.
CANDIDATE, MISSED, MISTAKEN = 16, 0.02, 0.001
#: Symbols of a token that take part in training; scoring takes all of them.
TRAINED = 48
ALPHA = 0.05

#: The base patterns, in the order in which kinds are listed.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "format")

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % CANDIDATE)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base spans, sorted."""
    found = [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)] + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    return sorted(found)


_CLASS = {c: "U" for c in string.ascii_uppercase} | {c: "l" for c in string.ascii_lowercase} | {c: "D" for c in string.digits} | {c: "h" for c in "abcdef"}


def symbols(token: str) -> list[str]:
    """The first four characters themselves (formats have literal prefixes), then classes of characters."""
    return [*token[:4], *(_CLASS.get(c, c) for c in token[4:])]


@dataclass
class State:
    visits: int = 0
    ends: int = 0
    to: dict[str, int] = field(default_factory=dict)
    count: dict[str, int] = field(default_factory=dict)


class Automaton:
    """A probabilistic deterministic automaton, inferred from tokens by merging prefix-tree states."""

    def __init__(self, tokens: list[str], alpha: float = ALPHA):
        self.states = [State()]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        for t in tokens:
            at = 0
            self.states[0].visits += 1
            for c in symbols(t)[:TRAINED]:
                s = self.states[at]
                if c not in s.to:
                    s.to[c] = len(self.states)
                    self.states.append(State())
                s.count[c] = s.count.get(c, 0) + 1
                at = s.to[c]
                self.states[at].visits += 1
            self.states[at].ends += 1
        self._merge_all()
        alphabet = 44  # characters and classes of a token, for smoothing
        self.log = []
        for s in self.states:
            total = s.visits + 0.5
            self.log.append(({c: (s.to[c], math.log((n + 0.5 / alphabet) / total)) for c, n in s.count.items()}, math.log(0.5 / alphabet / total)))

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            p, q = self.states[a], self.states[b]
            if not p.visits or not q.visits:
                continue
            if self._differ(p.ends, p.visits, q.ends, q.visits):
                return False
            for c in p.count.keys() | q.count.keys():
                if self._differ(p.count.get(c, 0), p.visits, q.count.get(c, 0), q.visits):
                    return False
                if c in p.to and c in q.to:
                    todo.append((p.to[c], q.to[c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            p, q = self.states[a], self.states[b]
            p.visits += q.visits
            p.ends += q.ends
            for c, n in q.count.items():
                p.count[c] = p.count.get(c, 0) + n
                if c in p.to:
                    todo.append((p.to[c], q.to[c]))
                else:
                    p.to[c] = q.to[c]

    def _merge_all(self) -> None:
        red, fringe = [0], [(0, c) for c in sorted(self.states[0].to)]
        while fringe:
            parent, c = fringe.pop(0)
            blue = self.states[parent].to[c]
            if blue in red:
                continue
            known = next((r for r in red if self._compatible(r, blue)), None)
            if known is None:
                red.append(blue)
                fringe += [(blue, x) for x in sorted(self.states[blue].to)]
                continue
            self.states[parent].to[c] = known
            self._fold(known, blue)
            fringe += [(r, x) for r in red for x in sorted(self.states[r].to) if self.states[r].to[x] not in red and (r, x) not in fringe]
        number = {r: k for k, r in enumerate(red)}
        self.states = [State(self.states[r].visits, self.states[r].ends, {c: number.get(t, 0) for c, t in self.states[r].to.items()}, self.states[r].count) for r in red]

    def log_likelihood(self, token_symbols: list[str]) -> float:
        """Of the symbols; one that a state hasn't seen costs the smoothed minimum and returns to the start."""
        at, total = 0, 0.0
        for c in token_symbols:
            step, unseen = self.log[at]
            to, p = step.get(c, (0, unseen))
            at, total = to, total + p
        return total


@dataclass
class Formats:
    """Automata by label, and that of the background."""

    by_label: dict[str, Automaton]
    background: Automaton
    threshold: float = 0.0

    def score(self, token: str) -> float:
        s = symbols(token)
        return (max(a.log_likelihood(s) for a in self.by_label.values()) - self.background.log_likelihood(s)) / len(s)


def labelled_examples(per_label: int = PER_LABEL, seed: int = 7) -> tuple[list[tuple[str, str]], list[str]]:
    """(label, credential) rows in public formats and background tokens."""
    r = random.Random(seed)
    upper, lower, digits = string.ascii_uppercase, string.ascii_lowercase, string.digits
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    alnum, b64 = upper + lower + digits, upper + lower + digits + "+/"
    formats = {
        "access_id": lambda: r.choice(["AKIA", "ASIA"]) + some(upper + digits, 16),
        "base64": lambda: some(b64, r.choice([32, 40, 43, 64])) + r.choice(["", "=", "=="]),
        "url_safe": lambda: some(alnum + "-_", r.choice([24, 32, 43])),
        "prefixed": lambda: r.choice(["ghp_", "gho_", "ghs_"]) + some(alnum, 36),
        "named": lambda: some(lower, r.randint(2, 5)) + r.choice("_-") + some(alnum, r.randint(20, 40)),
        "lower": lambda: some(lower + digits, r.choice([28, 32, 36, 40, 46])),
        "short": lambda: some(alnum, r.randint(16, 22)),
        "chat": lambda: r.choice(["xoxb-", "xoxp-"]) + some(digits, 12) + "-" + some(digits, 12) + "-" + some(alnum, 24),
        "payment": lambda: r.choice(["sk_live_", "rk_live_", "sk_test_"]) + some(alnum, 24),
        "maps": lambda: "AIza" + some(alnum + "-_", 35),
        "signed": lambda: "eyJ" + some(alnum, r.randint(17, 40)) + ".eyJ" + some(alnum + "-_", r.randint(30, 60)) + "." + some(alnum + "-_", 43),
        "hex_upper": lambda: some(digits + "ABCDEF", r.choice([32, 40, 64])),
    }
    syllables = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve"]
    syllables += ["ch", "sch", "ge", "ung", "lich", "keit", "heit", "ein", "zu", "ver", "pf", "be", "au", "os", "mente", "ado", "tion", "ment", "eau", "que", "ier", "qu", "bl", "gr", "str", "om", "il", "up", "ck", "ow", "ly", "sh", "th", "ing", "wh", "and", "est", "al", "per", "con", "dis", "able", "ive", "ous", "ia", "ne", "ri", "lo", "mi", "ga"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    number = lambda: some(digits, r.randint(1, 12))
    background = [
        lambda: r.choice("./-_").join(r.choice([word, word, number])() for _ in range(r.randint(3, 7))),
        lambda: "".join(word() for _ in range(r.randint(3, 7))) + number(),
        lambda: f"{r.randint(1950, 2040)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}T{some(digits, 6)}.{some(digits, 6)}",
        lambda: r.choice(["/", "www.", "v", "img_", "file-"]) + "/".join(word() for _ in range(3)) + r.choice([".html", ".png", "_v2", "-2024"]),
        lambda: r.choice(".-").join(number() for _ in range(r.randint(4, 8))),
        lambda: "".join(word().title() for _ in range(r.randint(4, 7))) + some(digits, r.randint(1, 4)),
        lambda: "".join(r.choice([word().title, word().title, word, lambda: some(digits, r.randint(1, 4))])() for _ in range(r.randint(4, 8))),
        lambda: r.choice(["", "i", "e"]) + "".join(word().title() + r.choice(["", "", some(digits, r.randint(1, 3)), r.choice(["GB", "XL", "HD", "API", "UI"])]) for _ in range(r.randint(3, 5))) + r.choice(["", some(digits, 4)]),
        lambda: r.choice("=-_./+") * r.randint(CANDIDATE, 2 * CANDIDATE),
        lambda: "".join(word() for _ in range(r.randint(4, 9))),
        lambda: "".join(word() for _ in range(r.randint(4, 9))).capitalize() + r.choice(["", "."]),
        lambda: "".join(word().title() for _ in range(r.randint(4, 9))),
        lambda: "".join(word() for _ in range(r.randint(5, 9))).upper(),
        lambda: "-".join([some("0123456789abcdef", 8), *(some("0123456789abcdef", 4) for _ in range(3)), some("0123456789abcdef", 12)]),
        lambda: word().upper() + "_" + "_".join(word().upper() for _ in range(3)) + "_" + number(),
    ]
    rows = [(label, make()) for label, make in formats.items() for _ in range(per_label)]
    return rows, [make() for make in background for _ in range(per_label * 20 // len(background))]


def infer(credentials: list[tuple[str, str]], background: list[str], held_out: tuple[list[tuple[str, str]], list[str]]) -> Formats:
    """Formats from labelled rows, with the threshold from held-out ones."""
    by_label: dict[str, list[str]] = {}
    for label, token in credentials:
        by_label.setdefault(label, []).append(token)
    made = Formats({k: Automaton(v) for k, v in by_label.items()}, Automaton(background))
    right = sorted(made.score(t) for _, t in held_out[0] if len(t) >= CANDIDATE)
    wrong = sorted((made.score(t) for t in held_out[1] if len(t) >= CANDIDATE), reverse=True)
    made.threshold = (right[int(MISSED * len(right))] + wrong[int(MISTAKEN * len(wrong))]) / 2
    return made


@lru_cache(maxsize=1)
def default_formats() -> Formats:
    return infer(*labelled_examples(), labelled_examples(seed=8))


def find(text: str, formats: Formats) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans as (start, kind number, end), sorted."""
    base = base_spans(text)
    added, k = [], 0
    for m in _CANDIDATE.finditer(text):
        token = m[0].rstrip(".=-_") if m[0][-1] == "." else m[0]
        s, e = m.start(), m.start() + len(token)
        # base spans may overlap each other, candidates don't: those that end before this one are done with
        while k < len(base) and base[k][2] <= s:
            k += 1
        if len(token) >= CANDIDATE and not any(s < y and x < e for x, _, y in _until(base, k, e)) and formats.score(token) >= formats.threshold:
            added.append((s, 3, e))
    return base, sorted(base + added)


def _until(spans: list[tuple[int, int, int]], k: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Spans from the k-th on that start before end."""
    while k < len(spans) and spans[k][0] < end:
        yield spans[k]
        k += 1


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_format of every document."""
    model = docs.sparkSession.sparkContext.broadcast(formats or default_formats())

    def run(c: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format")}
        for t in c["text"]:
            base, every = find(t.decode(), model.value)
            kinds = [k for _, k, _ in every]
            for k, name in enumerate(("n_assign", "n_access", "n_hex", "n_format")):
                out[name].append(kinds.count(k))
            out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            out["spans"].append(written(every))
        return {"doc_id": c["doc_id"], **out}

    return map_batches(texts(docs), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")
