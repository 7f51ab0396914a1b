"""Toxic language: a lexicon trie met with Levenshtein automata, and context windows around what they find.

Terms are learned from labelled documents: words, or stems that begin many words, that toxic documents hold and
others don't. All terms form one trie; its product with the Levenshtein automata of the terms (no edit up to 4
letters, one from 5, two from 9) is a finite automaton over letters, built state by state as words need it, so a
misspelled term costs what a plain one does. Each hit is weighed by how surely its term and distance meant a toxic
label in training (0.45 at least for a misspelling that no harmless text has; one edit in a long term nearly as the
term), and by its window of words: quotation marks around it and words that in training stood near hits
in harmless documents (reporting, quoting) lower it; others raise it. A document's score is 1 - prod(1 - weight).

Defined results: null and empty texts score 0, as all texts do where no label could be learned from. Repeated rows
are scored one by one; repeated labels of an id count once, toxic if any says so. Words are runs of letters and
digits, lower-cased.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended

#: Lengths of the stems that are tried.
STEMS = (4, 5, 6, 7, 8, 10)
#: A term from this length on is enough alone with one edit.
LONG = 9
_WORD = re.compile(r"[^\W_]+")
#: Without the apostrophe's forms, of which contractions have pairs.
_QUOTES = "\"“”„«»‹›"
_REPORTS = frozenset("said says quote quoted quoting called word term slur cites cited reported writes wrote dit cité mot sagte zitat wort dijo cita palabra".split())


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class Lexicon:
    """terms: (text, whether it is a stem). weights: term number -> by distance, the weight of a hit."""

    terms: list[tuple[str, bool]] = field(default_factory=list)
    weights: list[list[float]] = field(default_factory=list)
    context: dict[str, float] = field(default_factory=dict)


class Matcher:
    """The product of the trie and the automata, as a deterministic automaton built on demand. A state is a set of
    (trie node, edits so far); a state keeps the best (distance, term) that it accepts."""

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.most: list[int] = [0]  # edits that some term below a node allows
        self.terms = terms
        for k, (term, _) in enumerate(terms):
            node, allowed = 0, edits_allowed(term)
            self.most[0] = max(self.most[0], allowed)
            for ch in term:
                if ch not in self.child[node]:
                    self.child[node][ch] = len(self.child)
                    self.child.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.child[node][ch]
                self.most[node] = max(self.most[node], allowed)
            self.ends[node].append(k)
        self.letters = {ch for c in self.child for ch in c}
        self.start = self._close({(0, 0)})
        self.states: dict[frozenset, int] = {}
        self.next: list[dict[str, int]] = []
        self.other: list[int] = []
        self.whole: list[tuple[int, int] | None] = []
        self.stem: list[tuple[int, int] | None] = []
        self.sets: list[frozenset] = []
        self.first = self._state(self.start)

    def _close(self, items: set) -> frozenset:
        todo, seen = list(items), set(items)
        while todo:  # a term's letter left out of the word
            node, e = todo.pop()
            for to in self.child[node].values():
                if e < self.most[to] and (to, e + 1) not in seen:
                    seen.add((to, e + 1))
                    todo.append((to, e + 1))
        least: dict[int, int] = {}
        for node, e in seen:
            least[node] = min(e, least.get(node, 99))
        return frozenset(least.items())

    def _state(self, items: frozenset) -> int:
        if items not in self.states:
            self.states[items] = len(self.next)
            self.next.append({})
            self.other.append(-2)
            self.sets.append(items)
            hits = sorted((e, k) for node, e in items for k in self.ends[node] if e <= edits_allowed(self.terms[k][0]))
            self.whole.append(hits[0] if hits else None)
            stems = [h for h in hits if self.terms[h[1]][1]]
            self.stem.append(stems[0] if stems else None)
        return self.states[items]

    def _step(self, state: int, ch: str) -> int:
        """-1: nothing can match any more."""
        known = ch in self.letters
        if not known and self.other[state] != -2:
            return self.other[state]
        out = set()
        for node, e in self.sets[state]:
            for letter, to in self.child[node].items():
                if letter == ch:
                    out.add((to, e))
                elif e < self.most[to]:
                    out.add((to, e + 1))
            if e < self.most[node]:  # a letter too many
                out.add((node, e + 1))
        to = self._state(self._close(out)) if out else -1
        if known:
            self.next[state][ch] = to
        else:
            self.other[state] = to
        return to

    def find(self, word: str) -> tuple[int, int] | None:
        """(distance, term number) of the best match of a whole word, or of a stem at its beginning."""
        state, best = self.first, None
        for ch in word:
            to = self.next[state].get(ch)
            state = self._step(state, ch) if to is None else to
            if state < 0:
                return best
            got = self.stem[state]
            if got is not None and (best is None or got < best):
                best = got
        got = self.whole[state]
        return got if got is not None and (best is None or got < best) else best


def context_factor(text: str, spans: list[tuple[int, int]], at: int, words: list[str], context: dict[str, float], window: int) -> float:
    """Over 1: like abuse; under 1: like quotation."""
    a, b = spans[max(0, at - window)][0], spans[min(len(spans) - 1, at + window)][1]
    s, e = spans[at]
    odds = 0.0
    before, after = text[max(a, s - 40) : s], text[e : min(b, e + 40)]
    if any(q in before for q in _QUOTES) and any(q in after for q in _QUOTES):
        odds -= 1.5
    near = words[max(0, at - window) : at] + words[at + 1 : at + 1 + window]
    if any(w in _REPORTS for w in near[:window]):
        odds -= 0.5
    odds += max(-1.5, min(1.5, sum(context.get(w, 0.0) for w in near)))
    return math.exp(odds)


def score(text: str | None, lexicon: Lexicon, matcher: Matcher, known: dict, window: int = 6) -> tuple[float, int]:
    """(score, number of hits). known keeps what words matched; it is emptied when it has a million words."""
    if not text:
        return 0.0, 0
    low = text.lower()
    found = {}
    for w in set(_WORD.findall(low)):
        if w in known:
            hit = known[w]
        else:
            if len(known) > 1_000_000:
                known.clear()
            hit = known[w] = matcher.find(w)
        if hit is not None:
            found[w] = hit
    if not found:
        return 0.0, 0
    at = [(m.start(), m.end()) for m in _WORD.finditer(low)]
    words = [low[a:b] for a, b in at]
    left, n = 0.0, 0
    for i, w in enumerate(words):
        if w in found:
            distance, term = found[w]
            weight = lexicon.weights[term][distance]
            if weight > 0:
                odds = weight / (1 - weight) * context_factor(low, at, i, words, lexicon.context, window)
                left += math.log1p(odds)
                n += 1
    return 1 - math.exp(-left), n


def _without_copies(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """One row of each set of near copies, so that the words of an often-copied text don't look like terms."""
    seen: dict[tuple[int, int], int] = {}
    out = []
    for i, (text, y) in enumerate(rows):
        least: dict[int, int] = {}
        for w in set(_WORD.findall(text.lower())):
            h = zlib.crc32(w.encode()) * 0x9E3779B1 & 0xFFFFFFFF
            k = h & 7
            if h < least.get(k, 1 << 32):
                least[k] = h
        keys = list(least.items())
        same = Counter(seen[k] for k in keys if k in seen)
        if not keys or not same or same.most_common(1)[0][1] * 2 <= len(keys):
            out.append((text, y))
            for k in keys:
                seen.setdefault(k, i)
    return out


def fit(rows: list[tuple[str, int]], min_docs: int = 4, window: int = 6, clean_weight: float = 8.0) -> Lexicon:
    """A lexicon of (text, toxic 0 or 1) rows. clean_weight: harmless documents in the corpus for each in the sample, toxic
    ones counting once."""
    rows = _without_copies(rows)
    toxic: Counter = Counter()
    clean: Counter = Counter()
    whole: Counter = Counter()
    holders: dict[str, set[int]] = {}
    n_toxic = sum(1 for _, y in rows if y)
    n_clean = len(rows) - n_toxic
    if not n_toxic or not n_clean:
        return Lexicon()
    docs = [(set(_WORD.findall(t.lower())), y) for t, y in rows]
    for i, (ws, y) in enumerate(docs):
        if y:
            whole.update(ws)
            stems = {w[:k] for w in ws for k in STEMS if len(w) >= k} | ws
            toxic.update(stems)
            for s in stems:
                holders.setdefault(s, set()).add(i)
    wanted = {s for s, n in toxic.items() if n >= min_docs}
    for ws, y in docs:
        if not y:
            clean.update(({w[:k] for w in ws for k in STEMS if len(w) >= k} | ws) & wanted)
    # surely toxic: the rate in toxic documents, smoothed, is 20 times the rate in others
    rate = {s: ((toxic[s] + 0.1) / (n_toxic + 1), (clean[s] + 0.5) / (n_clean + 1)) for s in wanted}
    good = [s for s in wanted if rate[s][0] > 20 * rate[s][1] and (toxic[s] >= 8 or clean[s] == 0)]
    # cover the toxic documents: most new documents first; of stems with the same documents the longest. Each term needs
    # min_docs documents that fewer than three terms cover, so there are at most 3 * n_toxic / min_docs of them
    terms: list[tuple[str, bool]] = []
    good.sort(key=lambda s: (-toxic[s], -len(s), s))
    covered: Counter = Counter()
    for s in good:
        if any(s.startswith(t) and stem for t, stem in terms):
            continue
        longer = [holders[t] for t, _ in terms if t.startswith(s)]
        if sum(1 for i in holders[s].difference(*longer) if covered[i] < 3) >= min_docs:
            terms.append((s, whole[s] < 0.8 * toxic[s]))
            covered.update(holders[s])
    lexicon = Lexicon(terms)
    matcher = Matcher(terms)
    seen: dict[tuple[int, int], list[int]] = {}
    near: dict[str, list[int]] = {}
    known: dict = {}
    for (ws, y), (text, _) in zip(docs, rows):
        hits = {}
        for w in ws:
            if w not in known:
                known[w] = matcher.find(w)
            if known[w] is not None:
                hits[w] = known[w]
        for h in set(hits.values()):
            seen.setdefault((h[1], h[0]), [0, 0])[y] += 1
        if hits:
            words = _WORD.findall(text.lower())
            around = {v for i, w in enumerate(words) if w in hits for v in words[max(0, i - window) : i + window + 1] if v not in hits}
            for v in around:
                near.setdefault(v, [0, 0])[y] += 1
    for k in range(len(terms)):
        row = []
        for distance in range(3):
            no, yes = seen.get((k, distance), [0, 0])
            # of documents like the corpus
            sure = (yes + 0.1) / (yes + 0.1 + clean_weight * (no + 0.5)) if yes + no else 0.0
            if distance and not no:  # no harmless text speaks against it: a long term's misspelling nearly as the term
                sure = max(sure, min(row[0], 0.6) if distance == 1 and len(terms[k][0]) >= LONG else 0.0, 0.45)
            row.append(0.0 if sure < 0.3 else min(0.98, sure))
        lexicon.weights.append(row)
    with_hits = [sum(v[0] for v in near.values()), sum(v[1] for v in near.values())]
    if with_hits[0] >= 20:  # harmless documents with hits: only then is there anything to learn from windows
        lexicon.context = {w: math.log(((y + 0.5) / (with_hits[1] + 1)) / ((x + 0.5) / (with_hits[0] + 1))) * 0.3 for w, (x, y) in near.items() if x + y >= 5}
    return lexicon


def sample(docs: DataFrame, labels: DataFrame, teach, per_class: int, max_chars: int) -> list[tuple[str, int]]:
    """(text, toxic) of up to per_class documents of either class, the first by hash of the id."""
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    ids = docs.where(teach & F.col("text").isNotNull() & (F.length("text") <= max_chars)).select("doc_id").join(marks, "doc_id")
    first = [ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]  # each task sends its first
    chosen = [tuple(r) for part in first for r in part.collect()]
    label = dict(chosen)
    found = docs.where(teach & F.col("doc_id").isin(list(label)) & (F.length("text") <= max_chars)).select("doc_id", "text").limit(4 * per_class + 4).collect() if label else []
    return sorted((r["text"], int(label[r["doc_id"]])) for r in found if r["text"] is not None)


def train(docs: DataFrame, labels: DataFrame, teach=None, per_class: int = 1500, max_chars: int = 20_000) -> Lexicon:
    """Learn from documents (doc_id, text) and labels (doc_id, toxic) for which teach holds. Bounds of the sample:
    per_class whole texts of either class, of at most max_chars characters."""
    return fit(sample(docs, labels, F.lit(True) if teach is None else teach, per_class, max_chars))


def predict(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs with `score`, `predicted` and `hits`; only `text` is looked at."""
    docs = docs.drop("score", "predicted", "hits")
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, known = shared.value, {}
        matcher = Matcher(lexicon.terms)
        for batch in batches:
            got = [score(t.as_py(), lexicon, matcher, known) for t in batch.column(at)]
            s = np.array([min(1.0, max(0.0, x)) for x, _ in got])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), pa.array([n for _, n in got], pa.int32())],
                names=[*batch.schema.names, "score", "predicted", "hits"],
            )

    return docs.mapInArrow(run, extended(docs.schema, "score double, predicted int, hits int"))
