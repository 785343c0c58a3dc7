"""Secret scans: fixed patterns, and probabilistic automata inferred from the credentials that they label.

Base: three patterns find credentials and label them by kind. Each kind's automaton, and one of ordinary long tokens,
is inferred from a prefix tree with counts: states are merged (with all that follows, so that the result stays
deterministic) if a Hoeffding bound says that their shares of ends and of each symbol could be the same. Symbols are
classes of characters, and a character has its class's probability over the size of the class.

Merged states forget how long a value is, so that the length has a likelihood of its own. A token in capitals may be an
ordinary one in small letters.

All candidates, the tokens of a text that have the alphabet and the least length of the labelled kinds, are then scored
under every automaton; nothing but the likelihood decides. One that no base span
touches becomes a span of its own, of kind ``format``, if a credential's automaton gives its characters a better
likelihood than the ordinary one by a margin, and one that is no worse than that of the kind's own credentials.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

# The base patterns, in the order in which their kinds are listed, and the least lengths.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "format")
#: A text without any of these (lower case) has no match of the first pattern.
_HINTS = ("passw", "secret", "token", "api_key", "apikey")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
#: About so many credentials of each kind, and ordinary tokens, are learnt from, chosen by a hash of the value.
SAMPLE = 2_000
#: Ordinary tokens are drawn from about so many documents (all where there are fewer), chosen by a hash of the id.
ORDINARY_DOCS = 20_000
#: Longer values are scored like others, but not learnt from.
LEARNT_LENGTH = 512
#: Verdicts on values that a task remembers before it starts anew.
REMEMBERED = 200_000
ALPHA = 0.05
#: Log-likelihood (natural, per character) by which a credential's automaton must lead the ordinary one.
MARGIN = 0.5
#: The lead over the whole value must reach this too, or short words that happen to look like one would pass.
EVIDENCE = 12.0
#: Slack below the least likelihood (per character) of the kind's own credentials.
SLACK = 0.15
#: Weights of values whose length is so many characters off (each counts twice at 0).
LENGTH_WEIGHTS = ((0, 0.25), (1, 0.15), (2, 0.10))
#: What it costs (natural log, over the whole value) that an ordinary token stands in capitals.
CAPITALS = 4.0
END = ""

# Classes of characters and how many characters each has.
_CLASSES = (("d", "0123456789"), ("h", "abcdef"), ("l", "ghijklmnopqrstuvwxyz"), ("H", "ABCDEF"), ("L", "GHIJKLMNOPQRSTUVWXYZ"))
_CLASS_OF = {ord(c): name for name, members in _CLASSES for c in members}
_LOG_SIZE = {name: math.log(len(members)) for name, members in _CLASSES}


def symbols(value: str) -> str:
    """Each character's class; characters outside the classes stand for themselves."""
    return value.translate(_CLASS_OF)


# ---------------------------------------------------------------- base patterns
def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, position of the kind, end, value) of each base match, by start, then kind."""
    found = []
    lower = text.lower()
    if any(h in lower for h in _HINTS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


# ---------------------------------------------------------------- grammar inference
def _differ(a: int, n: int, b: int, m: int) -> bool:
    """Whether shares a/n and b/m differ by more than the Hoeffding bound allows."""
    return abs(a / n - b / m) > math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))


class Automaton:
    """A deterministic probabilistic automaton; state 0 is the start. Counts come from the values it was inferred from."""

    def __init__(self, values: Counter[str]):
        self.next: list[dict[str, int]] = [{}]
        self.taken: list[Counter] = [Counter()]
        for value, n in sorted(values.items()):
            self._add(symbols(value), n)
        self._infer()
        self._settle(values)

    def _add(self, word: str, n: int) -> None:
        at = 0
        for s in word:
            self.taken[at][s] += n
            if s not in self.next[at]:
                self.next[at][s] = len(self.next)
                self.next.append({})
                self.taken.append(Counter())
            at = self.next[at][s]
        self.taken[at][END] += n

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.taken[a].total(), self.taken[b].total()
            if not n or not m:
                continue
            if any(_differ(self.taken[a][s], n, self.taken[b][s], m) for s in self.taken[a].keys() | self.taken[b].keys()):
                return False
            todo += [(self.next[a][s], self.next[b][s]) for s in self.next[a].keys() & self.next[b].keys()]
        return True

    def _infer(self) -> None:
        red, blue, parent = [0], [], {}
        for s, t in sorted(self.next[0].items()):
            blue.append(t)
            parent[t] = (0, s)
        while blue:
            # the best known state first
            blue.sort(key=lambda t: (-self.taken[t].total(), t))
            state = blue.pop(0)
            for r in red:
                if self._compatible(r, state):
                    source, s = parent[state]
                    self.next[source][s] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
            known = set(red)
            blue = []
            for r in red:
                for s, t in sorted(self.next[r].items()):
                    if t not in known:
                        known.add(t)
                        blue.append(t)
                        parent[t] = (r, s)

    def _fold(self, into: int, state: int) -> None:
        """Merge a tree below ``state`` into the automaton at ``into``."""
        todo = [(into, state)]
        while todo:
            a, b = todo.pop()
            self.taken[a] += self.taken[b]
            for s, t in self.next[b].items():
                if s in self.next[a]:
                    todo.append((self.next[a][s], t))
                else:
                    self.next[a][s] = t

    def _settle(self, values: Counter[str]) -> None:
        """Logs of all steps, with a little left for symbols never seen, and the least score of the values."""
        self.log, self.unseen = [], []
        for taken in self.taken:
            total = taken.total() + 0.5
            self.log.append({s: math.log(n / total) for s, n in taken.items()})
            self.unseen.append(math.log(0.5 / total / 80))
        self.least = min((self.score(v) for v in values), default=0.0)
        self.size = len(self.log)
        self.lengths = Counter(len(v) for v in values.elements())

    def length_score(self, n: int) -> float:
        """Natural log of the share of values of about that length: those two characters off count a little, and any length once in all."""
        near = sum(w * (self.lengths[n - d] + self.lengths[n + d]) for d, w in LENGTH_WEIGHTS)
        return math.log((near + 1 / (n * (n + 1))) / (self.lengths.total() + 1))

    def score(self, value: str) -> float:
        """Natural log-likelihood per character, the end included. An unseen symbol leads back to the start."""
        at, total = 0, 0.0
        for s in symbols(value):
            step = self.log[at].get(s)
            total += self.unseen[at] if step is None else step - _LOG_SIZE.get(s, 0.0)
            at = self.next[at].get(s, 0)
        total += self.log[at].get(END, self.unseen[at])
        return total / (len(value) + 1)


# ---------------------------------------------------------------- Spark side
def _labelled(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(``kind``, ``value``) of all base matches, and ordinary tokens of some documents as kind 3."""
    share = min(1.0, ORDINARY_DOCS / max(1, docs.count()))
    chosen = F.pmod(F.xxhash64(F.col(id_column)), F.lit(1 << 20)) < int(share * (1 << 20))

    def run(batches):
        for batch in batches:
            kinds, values = [], []
            for text, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                spans = base_spans(text)
                kinds += [k for _, k, _, _ in spans]
                values += [v for *_, v in spans]
                if some:
                    ends = 0
                    for start, _, stop, _ in [*spans, (len(text), 0, 0, "")]:
                        ordinary = set(CANDIDATE.findall(text[ends:start])) if start > ends else ()
                        kinds += [3] * len(ordinary)
                        values += ordinary
                        ends = max(ends, stop)
            kept = [i for i, v in enumerate(values) if len(v) <= LEARNT_LENGTH]
            yield pa.RecordBatch.from_arrays([pa.array([kinds[i] for i in kept], pa.int32()), pa.array([values[i] for i in kept], pa.string())], ["kind", "value"])

    return docs.select(F.col(text_column).cast("string"), chosen).mapInArrow(run, "kind int, value string")


def infer(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE) -> dict[str, Automaton]:
    """An automaton for each kind of credential found in ``docs`` and one, ``ordinary``, of other tokens.

    Each is inferred from about ``sample`` distinct values of up to ``LEARNT_LENGTH`` characters (documented bounds),
    chosen by a hash of the value.
    """
    values = _labelled(docs, id_column, text_column).groupBy("kind", "value").agg(F.count("*").alias("n"))
    values = materialise(values, "values")
    sizes = {r[0]: r[1] for r in values.groupBy("kind").count().collect()}
    share = F.coalesce(*[F.when(F.col("kind") == k, min(1.0, sample / n)) for k, n in sizes.items()], F.lit(0.0))
    draw = F.pmod(F.xxhash64("value"), F.lit(1 << 20)) / float(1 << 20)
    got = values.where(draw < share).collect()
    discard(values)
    names = ("assign", "access", "hex", "ordinary")
    # every distinct value counts once: copies of a document must not shape a format
    return {names[k]: Automaton(Counter(r.value for r in got if r.kind == k)) for k in sorted(sizes)}


def judge(value: str, automata: dict[str, Automaton]) -> tuple[float, str] | None:
    """Lead over ordinary tokens and kind of the automaton that takes the value for a credential, if one does."""
    ordinary, good = automata["ordinary"].score(value), []
    # tokens in capitals are rare among those learnt from, but most are words that are known in small letters
    if value.isupper():
        ordinary = max(ordinary, automata["ordinary"].score(value.lower()) - CAPITALS / (len(value) + 1))
    for kind, automaton in automata.items():
        if kind != "ordinary":
            score = automaton.score(value)
            # merged states forget how long a value is; its length is a part of the format
            lead = score - ordinary + (automaton.length_score(len(value)) - automata["ordinary"].length_score(len(value))) / (len(value) + 1)
            if score >= automaton.least - SLACK and lead >= MARGIN and lead * (len(value) + 1) >= EVIDENCE:
                good.append((lead, kind))
    return max(good, default=None)


def scan_text(text: str, automata: dict[str, Automaton], known: dict | None = None) -> tuple[list[tuple[int, int, str, str]], list[tuple[int, int, str, float]]]:
    """Base spans, and spans that only an automaton finds: (start, end, kind whose format it has, lead).

    ``known`` remembers verdicts on values. Without an automaton of ordinary tokens, or of any credential, there is
    nothing to compare and only base spans come out.
    """
    base, more, upto = base_spans(text), [], 0
    if "ordinary" not in automata or len(automata) < 2:
        return base, more
    known = {} if known is None else known
    for m in CANDIDATE.finditer(text):
        value = m[0]
        if value in known:
            verdict = known[value]
        else:
            verdict = judge(value, automata)
            if len(value) <= LEARNT_LENGTH:
                known[value] = verdict
        if verdict is None:
            continue
        while upto < len(base) and base[upto][2] <= m.start():
            upto += 1
        if not any(s < m.end() and m.start() < e for s, _, e, _ in base[upto:]):
            more.append((m.start(), m.end(), verdict[1], verdict[0]))
    return base, more


def scan(docs: DataFrame, automata: dict[str, Automaton], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id`` and ``spans`` (start, end in code points, kind, format, score) of each row; rows without spans too."""
    shared = docs.sparkSession.sparkContext.broadcast(automata)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("format", pa.string()), ("score", pa.float64())])

    def run(batches):
        known: dict = {}
        for batch in batches:
            out = []
            for text in batch.column(1):
                if len(known) > REMEMBERED:
                    known.clear()
                base, more = scan_text(text.as_py() or "", shared.value, known)
                spans = [(s, k, e, KINDS[k], None, None) for s, k, e, _ in base] + [(s, 3, e, "format", kind, lead) for s, e, kind, lead in more]
                out.append([{"start": s, "end": e, "kind": kind, "format": form, "score": lead} for s, _, e, kind, form, lead in sorted(spans, key=lambda x: x[:2])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(span))], ["id", "spans"])

    schema = "id long, spans array<struct<start: long, end: long, kind: string, format: string, score: double>>"
    return docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).mapInArrow(run, schema)


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Infer the automata from ``docs`` and scan them.

    Null counts as empty; an empty text has no spans. Whole texts are scanned. Repeated rows give equal rows. Without any
    credential in ``docs`` there is no automaton to score with and no span. An empty table gives an empty result.
    """
    return scan(docs, infer(docs, id_column, text_column), id_column, text_column)
