"""Secret scan: fixed patterns, and formats learned from what these find.

Base spans, leftmost and non-overlapping for each kind: assign (a keyword, : or =, a value of 12 characters or more), access
(AKIA...), hex (16 digits or more). Their values are labelled credentials. Every other run of VALUE characters of 12 or more that
touches no base span is a candidate.

Grammar inference (ALERGIA): for each kind, and for candidates as the background, the strings of a bounded sample become a prefix
tree with counts; states whose ending and following characters differ by no more than a Hoeffding bound allows are merged, and what
follows them is folded, until a probabilistic automaton is left. A candidate's format likelihood is the difference of its log
likelihoods under a kind's automaton and the background's. One that is above the kind's threshold becomes a span of that kind;
thresholds lie above every background string held out from learning, and above the lowest FLOOR of the credentials held out.

Tasks read each text once and keep spans, credentials and candidates; these are written, then sampled, then scored. The sample takes
SAMPLE distinct strings of each kind, BACKGROUND times as many candidates (the smallest by md5, at most LONGEST characters each): every task keeps its own smallest,
which merge to the table's. It is all that comes to the driver, where automata are learned and sent to tasks; everything is scored.

Defined results: a null text is empty and has no spans; null ids and repeated rows are documents like others; equal texts have equal
spans; a kind with fewer than LEAST sampled credentials learns nothing and adds nothing; an empty table gives no rows; where two
kinds would add one candidate, the likelier takes it; candidates are scored whole, whatever their length; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

# The kinds in their order, and what their base spans match.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs of 16 or more
VALUE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
_KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

SAMPLE, BACKGROUND = 4000, 4
LONGEST = 256
LEAST = 20
#: Of a sample, one string of this many is held out for the thresholds.
HELD_OUT = 4
FLOOR, ORDINARY = 0.05, 0.998
#: Confidence of the Hoeffding bound.
ALPHA = 0.05
#: Remembered scores in a task.
MEMO = 200_000
END = ""


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, int, str]]:
    """(start, end, kind's place, value) of a text's base spans, in order."""
    low = (text.encode("utf-8", "surrogatepass") if raw is None else raw).lower()
    found = []
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, spans: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, str]]:
    """(start, value) of the runs that touch no base span."""
    k, reach = 0, -1
    for m in VALUE.finditer(text):
        start, end = m.span()
        while k < len(spans) and spans[k][0] < end:
            reach = max(reach, spans[k][1])
            k += 1
        if reach <= start:
            yield start, m[0]


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_assign, n_access, n_hex, base (starts, ends, kinds), their values, and candidates (starts, values)."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, values, starts, tokens = [], [], [], [], []
            for raw in batch.column("text"):
                raw = raw.as_py()
                text = raw.decode("utf-8", "surrogatepass")
                found = base_spans(text, raw)
                counts.append([sum(x[2] == k for x in found) for k in range(3)])
                spans.append([n for x in found for n in x[:3]])
                values.append([x[3] for x in found])
                own = list(candidates(text, found))
                starts.append([x[0] for x in own])
                tokens.append([x[1] for x in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)), pa.array(spans, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.string()))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base", "base_values", "starts", "tokens"])

    return own.mapInArrow(read, "doc_id long, n_assign long, n_access long, n_hex long, base array<int>, base_values array<string>, starts array<int>, tokens array<string>")


def _order(value: str) -> bytes:
    return hashlib.md5(value.encode()).digest()


def sample(found: DataFrame, size: int = SAMPLE) -> list[list[str]]:
    """Of each kind, and of the candidates, the `size` distinct values (BACKGROUND times as many) that are smallest by md5, in that order."""
    kinds = len(KINDS) + 1
    sizes = [size] * len(KINDS) + [BACKGROUND * size]

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, bytes]] = [{} for _ in range(kinds)]

        def cut(k: int) -> None:
            held[k] = dict(sorted(held[k].items(), key=lambda x: x[1])[: sizes[k]])

        for batch in batches:
            for base, values, tokens in zip(*(batch.column(c).to_pylist() for c in ("base", "base_values", "tokens"))):
                for k, value in [*zip(base[2::3], values), *((kinds - 1, t) for t in tokens)]:
                    if len(value) <= LONGEST and value not in held[k]:
                        held[k][value] = _order(value)
                        if len(held[k]) >= 4 * sizes[k]:
                            cut(k)
        for k in range(kinds):
            cut(k)
        rows = [(k, v) for k in range(kinds) for v in held[k]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], names=["kind", "value"])

    rows = found.select("base", "base_values", "tokens").mapInArrow(least, "kind int, value string").groupBy("kind", "value").agg(F.md5("value").alias("place"))
    rows = materialize(rows, "secret-sample")
    return [[r.value for r in rows.where(F.col("kind") == k).orderBy("place").limit(sizes[k]).collect()] for k in range(kinds)]


class Automaton:
    """A probabilistic automaton: per state its visits, endings, and by character (next state, count)."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.visits, self.ends, self.next = [0], [0], [{}]
        for s in strings:
            at = 0
            self.visits[0] += 1
            for c in s:
                to, n = self.next[at].get(c, (None, 0))
                if to is None:
                    to = len(self.visits)
                    self.visits.append(0)
                    self.ends.append(0)
                    self.next.append({})
                self.next[at][c] = (to, n + 1)
                at = to
                self.visits[at] += 1
            self.ends[at] += 1
        self.width = math.sqrt(0.5 * math.log(2 / alpha))
        self._generalise()
        self._prepare()

    def _apart(self, n: int, of: int, m: int, of_m: int) -> bool:
        return of > 0 and of_m > 0 and abs(n / of - m / of_m) > self.width * (1 / math.sqrt(of) + 1 / math.sqrt(of_m))

    def _compatible(self, a: int, b: int) -> bool:
        """Neither these states nor those that follow both by the same characters differ beyond the bound."""
        pending = [(a, b)]
        while pending:
            a, b = pending.pop()
            if a == b:
                continue
            if self._apart(self.ends[a], self.visits[a], self.ends[b], self.visits[b]):
                return False
            mine, its = self.next[a], self.next[b]
            for c in mine.keys() | its.keys():
                to, n = mine.get(c, (None, 0))
                to_b, m = its.get(c, (None, 0))
                if self._apart(n, self.visits[a], m, self.visits[b]):
                    return False
                if to is not None and to_b is not None:
                    pending.append((to, to_b))
        return True

    def _fold(self, a: int, b: int) -> None:
        """b, the top of a tree, becomes part of a."""
        pending = [(a, b)]
        while pending:
            a, b = pending.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for c, (to_b, m) in self.next[b].items():
                to, n = self.next[a].get(c, (None, 0))
                self.next[a][c] = (to_b if to is None else to, n + m)
                if to is not None:
                    pending.append((to, to_b))

    def _generalise(self) -> None:
        """The most visited state that still hangs from a settled one is merged with the first settled state that it is compatible with, or settles."""
        settled, known = [0], {0}
        while True:
            hanging = [(-self.visits[to], k, c, to) for k, s in enumerate(settled) for c, (to, _) in self.next[s].items() if to not in known]
            if not hanging:
                break
            _, k, c, to = min(hanging)
            for s in settled:
                if self._compatible(s, to):
                    self.next[settled[k]][c] = (s, self.next[settled[k]][c][1])
                    self._fold(s, to)
                    break
            else:
                settled.append(to)
                known.add(to)
        place = {s: k for k, s in enumerate(settled)}
        self.visits, self.ends, self.next = [self.visits[s] for s in settled], [self.ends[s] for s in settled], [{c: (place[to], n) for c, (to, n) in self.next[s].items()} for s in settled]

    def _prepare(self) -> None:
        """Log probabilities: a state's own counts, smoothed by the automaton's, and for what a state has not seen the state that the character leads to most."""
        seen: dict[str, int] = {END: sum(self.ends)}
        leads: dict[str, dict[int, int]] = {}
        for s in self.next:
            for c, (to, n) in s.items():
                seen[c] = seen.get(c, 0) + n
                of = leads.setdefault(c, {})
                of[to] = of.get(to, 0) + n
        total = sum(seen.values()) + 69  # the characters of VALUE and the end, each once more
        share = {c: (n + 1) / total for c, n in seen.items()}
        self.rare = 1 / total
        self.usual = {c: max(sorted(of), key=of.get) for c, of in leads.items()}
        # As many visits as a state has different characters are taken to have been of others.
        weight = [len(s) + 1 for s in self.next]
        self.table = [{c: (to, math.log((n + w * share[c]) / (v + w))) for c, (to, n) in s.items()} for s, v, w in zip(self.next, self.visits, weight)]
        self.other = [{c: math.log(w * p / (v + w)) for c, p in share.items()} for v, w in zip(self.visits, weight)]
        self.unseen = [math.log(w * self.rare / (v + w)) for v, w in zip(self.visits, weight)]
        self.ending = [math.log((e + w * share[END]) / (v + w)) for e, v, w in zip(self.ends, self.visits, weight)]

    def log_likelihood(self, value: str) -> float:
        at, total = 0, 0.0
        for c in value:
            known = self.table[at].get(c)
            if known:
                at, more = known
            else:
                more = self.other[at].get(c, self.unseen[at])
                at = self.usual.get(c, at)
            total += more
        return total + self.ending[at]


class Formats:
    """The kinds' automata, the background's, and the thresholds of their differences."""

    def __init__(self, samples: list[list[str]]):
        learn = [[s for i, s in enumerate(own) if i % HELD_OUT] for own in samples]
        rest = [own[::HELD_OUT] for own in samples]
        self.background = Automaton(learn[-1])
        self.kinds: list[Automaton | None] = [Automaton(own) if len(own) >= LEAST else None for own in learn[:-1]]
        self.least = []
        for k, kind in enumerate(self.kinds):
            if kind is None:
                self.least.append(math.inf)
                continue
            own = sorted(self._gain(kind, s) for s in rest[k])
            ordinary = sorted(self._gain(kind, s) for s in rest[-1])
            below = max(0.0, ordinary[min(len(ordinary) - 1, int(ORDINARY * len(ordinary)))]) if ordinary else 0.0
            self.least.append(max(below, (below + own[int(FLOOR * len(own))]) / 2))

    def _gain(self, kind: Automaton, value: str) -> float:
        return kind.log_likelihood(value) - self.background.log_likelihood(value)

    def kind(self, value: str) -> int | None:
        """The place of the kind that a candidate's format speaks for."""
        gains = [(self._gain(kind, value), -k) for k, kind in enumerate(self.kinds) if kind]
        gain, k = max(((g, k) for g, k in gains if g > self.least[-k]), default=(0.0, None))
        return None if k is None else -k


def learn(found: DataFrame, size: int = SAMPLE) -> Formats:
    return Formats(sample(found, size))


def _text_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


def spans_of(found: DataFrame, formats: Formats) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added) from scanned(), materialised."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int | None] = {}
        for batch in batches:
            digests, whole, added = [], [], []
            for base, starts, tokens in zip(*(batch.column(c).to_pylist() for c in ("base", "starts", "tokens"))):
                own = sorted(zip(base[::3], base[2::3], base[1::3]))
                more = []
                for start, value in zip(starts, tokens):
                    if value in memo:
                        kind = memo[value]
                    else:
                        if len(memo) >= MEMO:
                            memo.clear()
                        kind = formats.kind(value)
                        if len(value) <= LONGEST:
                            memo[value] = kind
                    if kind is not None:
                        more.append((start, kind, start + len(value)))
                digests.append(hashlib.sha256(_text_of(own).encode()).hexdigest())
                whole.append(_text_of(sorted(own + more)))
                added.append(len(more))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_assign", "n_access", "n_hex")), pa.array(digests, pa.string()), pa.array(whole, pa.string()), pa.array(added, pa.int64())],
                                             names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    return found.mapInArrow(score, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")


def query(spark, sf_dir: str) -> DataFrame:
    found = materialize(scanned(table(spark, sf_dir, "documents")), "secret-candidates")
    return spans_of(found, learn(found))
