"""Secret scans with grammars inferred from labelled credentials.

The base patterns find and label credentials. For each kind, a bounded sample of the
distinct values becomes a prefix tree with counts; states whose futures are statistically
alike are merged, which leaves a probabilistic automaton of the format. One more automaton
is learned from ordinary tokens. Every other run of credential characters is then scored,
whole and in its parts behind separators, if it is as long as the labelled values are: a
part is added where its likelihood a character under some format is as high as that of
nearly all labelled values, and higher than under the ordinary automaton. Of parts that
overlap the one furthest above its bar is added.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import math
import re
import string
from collections import Counter, deque
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import column

#: Fixed patterns. A match is kept if the named part has the length given.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex")
ADDED, ORDINARY = "format", "ordinary"

#: Distinct values a kind, and ordinary tokens, that the automata are learned from, and the
#: characters of each that are learned. All values are scored whole.
SAMPLE, LEARNED_CHARS, BUCKETS = 1000, 64, 64
#: Shortest run that is looked at: the least length of a base value.
SHORTEST = 6
#: One in HELD labelled values sets the bar; below FEW values each one does in turn.
HELD, FEW = 4, 20
#: Remembered verdicts of a task.
REMEMBERED = 100_000
#: Merging: the chance to keep alike states apart. Scoring: the share of labelled values
#: that may score below the bar, and the likelihood of a symbol never seen in a state.
ALPHA, TAIL, UNSEEN = 0.05, 0.02, 1e-4
#: Weight, in visits, of how common a sort of symbol is in the kind, and the sorts' sizes.
SMOOTHING = 1.0
_SORTS = {"lower": 26, "upper": 26, "digit": 10, "other": 7}
_SORT = {
    **dict.fromkeys(string.ascii_lowercase, "lower"),
    **dict.fromkeys(string.ascii_uppercase, "upper"),
    **dict.fromkeys(string.digits, "digit"),
}

_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
_PARTS = (re.compile(r"[^=/]+={0,2}"), re.compile(r"[^=/._-]+"))
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal: these are the long ones of _HEX
_DIGIT = re.compile("[0-9]")
_LEARNED = "kind string, value string"
_SPANS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the base patterns, by start and then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "apikey", "api_key")):
        found += [("assign", *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span(), m[0]) for m in _LONG_HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def runs(text: str, taken: Iterable[tuple[int, int]], least: int = SHORTEST, digit: bool = True) -> list[tuple[int, int]]:
    """Maximal runs of credential characters, of at least `least` of them, that touch no
    span of `taken`; with `digit` those that hold a digit and something else."""
    spans, found = sorted(taken), []
    at = 0
    reach = 0  # furthest end of the spans that begin before the run's end
    for m in _RUN.finditer(text):
        a, b = m.span()
        while at < len(spans) and spans[at][0] < b:
            reach = max(reach, spans[at][1])
            at += 1
        if reach > a or b - a < least:
            continue
        if digit and (m[0].isdigit() or not _DIGIT.search(m[0])):
            continue
        found.append((a, b))
    return found


def parts(value: str) -> list[tuple[int, int]]:
    """The run itself, what follows its first and its last equals sign, and its pieces
    between separators: between `=` and `/`, and between these and `.`, `_`, `-`."""
    found = {(0, len(value)): None}
    inner = value.rstrip("=")
    for cut in (inner.find("="), inner.rfind("=")):
        if cut >= 0:
            found[cut + 1, len(value)] = None
    for pattern in _PARTS:
        found.update(dict.fromkeys(m.span() for m in pattern.finditer(value)))
    return [(a, b) for a, b in found if b - a >= SHORTEST]


def _observed(sample: int):
    """Per batch and kind the distinct values, cut to what is learned, with the smallest
    MD5, at most `sample`."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            values: dict[str, set[str]] = {}
            for text in batch["text"]:
                text = text or ""
                base = base_spans(text)
                for kind, _, _, value in base:
                    values.setdefault(kind, set()).add(value[:LEARNED_CHARS])
                usual = values.setdefault(ORDINARY, set())
                usual.update(text[a : min(b, a + LEARNED_CHARS)] for a, b in runs(text, [(s, e) for _, s, e, _ in base]))
            rows = [
                (kind, v)
                for kind, found in values.items()
                for v in heapq.nsmallest(sample, found, key=lambda v: hashlib.md5(v.encode()).digest())
            ]
            yield pd.DataFrame(rows, columns=["kind", "value"])

    return run


class Automaton:
    """Probabilistic automaton of the format of some strings."""

    def __init__(self, values: Iterable[str], alpha: float = ALPHA):
        values = [v[:LEARNED_CHARS] for v in values]
        self.visits, self.ends = [0], [0]
        self.next: list[dict[str, int]] = [{}]
        for value in values:
            state = 0
            self.visits[0] += 1
            for symbol in value:
                state = self._child(state, symbol)
                self.visits[state] += 1
            self.ends[state] += 1
        self.used: list[dict[str, int]] = [{s: self.visits[t] for s, t in c.items()} for c in self.next]
        # how often each sort of symbol occurs, which speaks where a state is silent
        sorts = Counter({sort: 1 for sort in _SORTS})
        for value in values:
            sorts.update(_SORT.get(symbol, "other") for symbol in value)
        total = sum(sorts.values())
        self.common = {sort: n / total / _SORTS[sort] for sort, n in sorts.items()}
        self._merge_states(alpha)
        self._logs: list[dict[str, float]] = [{} for _ in self.next]

    def _child(self, state: int, symbol: str) -> int:
        if symbol not in self.next[state]:
            self.next[state][symbol] = len(self.next)
            self.visits.append(0)
            self.ends.append(0)
            self.next.append({})
        return self.next[state][symbol]

    def _merge_states(self, alpha: float) -> None:
        """Visit states by breadth; each joins the first kept state that is alike, or is kept."""
        kept, place = [0], {0: 0}
        fringe = deque((0, symbol) for symbol in sorted(self.next[0]))
        while fringe:
            parent, symbol = fringe.popleft()
            state = self.next[parent][symbol]
            if state in place:
                continue
            for other in kept:
                if self._alike(other, state, alpha):
                    self.next[parent][symbol] = other
                    grown = [(place[a], s) for a, s in self._fold(other, state) if a in place]
                    fringe.extend((kept[i], s) for i, s in sorted(grown))
                    break
            else:
                place[state] = len(kept)
                kept.append(state)
                fringe.extend((state, s) for s in sorted(self.next[state]))

    def _alike(self, a: int, b: int, alpha: float) -> bool:
        pairs = [(a, b)]
        scale = math.sqrt(0.5 * math.log(2 / alpha))
        while pairs:
            a, b = pairs.pop()
            n, m = self.visits[a], self.visits[b]
            bound = scale * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if bound < 1:
                if abs(self.ends[a] / n - self.ends[b] / m) > bound:
                    return False
                for s in self.used[a].keys() | self.used[b].keys():
                    if abs(self.used[a].get(s, 0) / n - self.used[b].get(s, 0) / m) > bound:
                        return False
                pairs += [(t, self.next[b][s]) for s, t in self.next[a].items() if s in self.next[b]]
        return True

    def _fold(self, into: int, state: int) -> list[tuple[int, str]]:
        """Add the tree below `state` to what lies below `into`. The ways that are new there."""
        pairs, new = [(into, state)], []
        while pairs:
            a, b = pairs.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for s, n in self.used[b].items():
                self.used[a][s] = self.used[a].get(s, 0) + n
            for s, t in self.next[b].items():
                if s in self.next[a]:
                    pairs.append((self.next[a][s], t))
                else:
                    self.next[a][s] = t
                    new.append((a, s))
        return new

    def _log(self, state: int, symbol: str) -> float:
        seen = self.used[state].get(symbol, 0) + SMOOTHING * self.common[_SORT.get(symbol, "other")]
        return math.log(max(seen / (self.visits[state] + SMOOTHING), UNSEEN))

    def score(self, value: str) -> float:
        """Log likelihood a symbol. A symbol without a way leads back to the start."""
        state, total = 0, 0.0
        for symbol in value:
            logs = self._logs[state]
            if symbol not in logs:
                logs[symbol] = self._log(state, symbol)
            total += logs[symbol]
            state = self.next[state].get(symbol, 0)
        return total / max(len(value), 1)


class Formats:
    """Automata of the kinds with their bars and least lengths, and that of ordinary tokens.

    A kind with any labelled value has an automaton. Its bar is what all but TAIL of the
    labelled values that it has not seen reach (a single value judges itself), its least
    length and whether it needs a digit are those of all but TAIL of them. Tokens with a
    part above a bar may be unmarked credentials, and ordinary ones are learned without them.
    """

    def __init__(self, credentials: dict[str, list[str]], ordinary: list[str]):
        self.kinds: list[tuple[Automaton, float, int, bool]] = []
        self._known: dict[str, list[tuple[int, int]]] = {}
        for kind in KINDS:
            values = credentials.get(kind, [])
            if not values:
                continue
            if len(values) >= FEW:
                automaton = Automaton(v for i, v in enumerate(values) if i % HELD)
                scores = [automaton.score(v) for v in values[::HELD]]
            else:
                automaton = Automaton(values)
                others = ([v for j, v in enumerate(values) if j != i] or values for i in range(len(values)))
                scores = [Automaton(seen).score(v) for v, seen in zip(values, others)]
            bar, below = sorted(scores)[int(TAIL * len(scores))], int(TAIL * len(values))
            lengths = sorted(map(len, values))
            digit = sum(not _DIGIT.search(v) for v in values) <= TAIL * len(values)
            self.kinds.append((automaton, bar, max(lengths[below], SHORTEST), digit))
        self.least = min((k[2] for k in self.kinds), default=SHORTEST)
        self.digit = all(k[3] for k in self.kinds)
        self.ordinary: Automaton | None = None
        self.ordinary = Automaton(
            v for v in ordinary if all(self.margin(v[a:b]) is None for a, b in parts(v))
        )

    def margin(self, value: str) -> float | None:
        """How far a value stands above the bar of its best kind; None below all of them
        and where it is as likely an ordinary token."""
        usual, best = None, None
        has_digit = bool(_DIGIT.search(value)) and not value.isdigit()
        for automaton, bar, least, digit in self.kinds:
            if len(value) < least or (digit and not has_digit):
                continue
            if (score := automaton.score(value)) < bar:
                continue
            if usual is None:
                usual = self.ordinary.score(value) if self.ordinary else -math.inf
            if score > usual:
                best = max(score - bar, score - bar if best is None else best)
        return best

    def credential(self, value: str) -> bool:
        return self.margin(value) is not None

    def inside(self, value: str) -> list[tuple[int, int]]:
        """The parts of a run that are credentials, none overlapping another."""
        if value not in self._known:
            rated = [(m, b - a, a, b) for a, b in parts(value) if (m := self.margin(value[a:b])) is not None]
            found: list[tuple[int, int]] = []
            for _, _, a, b in sorted(rated, key=lambda r: (-r[0], -r[1], r[2])):
                # sorted by place, so that two neighbours tell
                i = bisect.bisect(found, (a, b))
                if (i == 0 or found[i - 1][1] <= a) and (i == len(found) or b <= found[i][0]):
                    found.insert(i, (a, b))
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            if len(value) > 10 * LEARNED_CHARS:
                return found
            self._known[value] = found
        return self._known[value]


def learn_formats(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Formats:
    """Formats of the credentials that the base patterns label in `docs`. Of each kind, and
    of ordinary tokens, at most `sample` distinct values with the smallest MD5 are learned
    from, LEARNED_CHARS characters each; that much goes to the driver."""
    texts = docs.select(column(text_col).alias("text"))
    # first within buckets, so that what one task sorts for a kind does not grow with the input
    bucket = Window.partitionBy("kind", "bucket").orderBy("key", "value")
    key = Window.partitionBy("kind").orderBy("key", "value")
    rows = (
        texts.mapInPandas(_observed(sample), _LEARNED)
        .distinct()
        .withColumns({"key": F.md5("value"), "bucket": F.pmod(F.hash("value"), F.lit(BUCKETS))})
        .withColumn("nth", F.row_number().over(bucket))
        .filter(F.col("nth") <= sample)
        .withColumn("nth", F.row_number().over(key))
        .filter(F.col("nth") <= sample)
        .orderBy("kind", "nth")
        .select("kind", "value")
        .collect()
    )
    values: dict[str, list[str]] = {}
    for kind, value in rows:
        values.setdefault(kind, []).append(value)
    return Formats(values, values.get(ORDINARY, []))


def _judge(formats: Formats):
    place = {k: i for i, k in enumerate((*KINDS, ADDED))}

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            text = text or ""
            spans = [(k, a, b) for k, a, b, _ in base_spans(text)]
            added = [
                (ADDED, a + start, a + end)
                for a, b in (runs(text, [s[1:] for s in spans], formats.least, formats.digit) if formats.kinds else ())
                for start, end in formats.inside(text[a:b])
            ]
            joined = [
                ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(s, key=lambda x: (x[1], place[x[0]])))
                for s in (spans, spans + added)
            ]
            kinds = [k for k, _, _ in spans]
            rows.append((*map(kinds.count, KINDS), hashlib.sha256(joined[0].encode()).hexdigest(), joined[1]))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return F.pandas_udf(run, _SPANS)


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, formats: Formats | None = None
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    `spans` lists kind:start:end of all spans by start, in code points; base ones come from
    the patterns, those of kind `format` from the automata, which are learned from the same
    documents unless `formats` are given. Null is empty: no spans. Repeated rows and null
    ids pass through. An empty table gives an empty result. Other columns are not looked at.
    """
    formats = formats or learn_formats(docs, text_col, sample)
    return docs.select(column(id_col).alias("doc_id"), _judge(formats)(column(text_col)).alias("s")).select("doc_id", "s.*")
