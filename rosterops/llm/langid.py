"""Language identification by cross-parsing entropy.

The labelled text of each language becomes a suffix automaton. A text is parsed against each
one: every phrase is the longest piece, from where the last phrase ended, that occurs in that
language's text. The number of phrases times the logarithm of the length of the text parsed
against, per character, estimates the cross entropy; the language with the least wins.

Automata are tables over the lower-case letters of the labelled text, one code for everything
that is no letter and one for letters never seen; rare letters are kept as sparse edges. A batch of texts is cut
into strips that are parsed side by side, a step for all strips and languages at a time, so
one long text costs no more than many short ones. A strip begins a phrase of its own.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterops.llm.frames import annotate, kept, pick, restored

ROWS = 64  # labelled rows per language
ROW_CHARS = 3_000  # characters used of each of them
CHARS, ALL_CHARS = 24_000, 200_000  # characters per language, and of all languages together
DENSE = 256  # most frequent letters, looked up in a table; the edges of all others in a sorted list
STRIP = 512
BATCH_CHARS = 1 << 20
UNKNOWN = "und"
BREAK, UNSEEN, PAD = 0, 1, 2
_FLAG = 1 << 30


def letter_table() -> np.ndarray:
    """For each code point: that of its lower-case letter, 0 for what is no letter."""
    return kept(("letters",), _letter_table)


def _letter_table() -> np.ndarray:
    table = np.zeros(0x110000, np.int32)
    for code in range(0x110000):
        sign = chr(code)
        if sign.isalpha():
            low = sign.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters as code points, each run of other characters as one 0."""
    found = letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = found != 0
    keep[1:] |= found[:-1] != 0
    return found[keep]


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a row of codes; state 0 is the root."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for code in codes:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        state = last
        while state >= 0 and code not in edges[state]:
            edges[state][code] = new
            state = link[state]
        if state >= 0:
            target = edges[state][code]
            if length[target] != length[state] + 1:
                copy = len(edges)
                edges.append(dict(edges[target]))
                length.append(length[state] + 1)
                link.append(link[target])
                while state >= 0 and edges[state].get(code) == target:
                    edges[state][code] = copy
                    state = link[state]
                link[target] = target = copy
            link[new] = target
        last = new
    return edges


class Model:
    """One table for all languages. An entry is the row of the next state; its flag says that
    a phrase ended there and a new one began.

    The ``DENSE`` most frequent letters have a column each. The edges of all other letters are a sorted
    list of (state, letter) keys, looked up for the few places where such a letter stands.
    """

    def __init__(self, samples: dict[str, list[str]], dense: int = DENSE) -> None:
        self.languages = sorted(samples)
        rows = {name: [letters_of(text) for text in samples[name]] for name in self.languages}
        seen, counts = np.unique(np.concatenate([r for some in rows.values() for r in some] or [np.zeros(0, np.int32)]), return_counts=True)
        self.alphabet, counts = seen[seen != 0], counts[seen != 0]
        self.codes = np.empty(len(self.alphabet), np.int64)
        self.codes[np.argsort(-counts, kind="stable")] = np.arange(len(self.alphabet)) + 3
        self.width, self.span = min(len(self.alphabet), dense) + 3, len(self.alphabet) + 3
        parts, roots, weights, base = [], [], [], 0
        keys, targets = [], []
        for name in self.languages:
            codes = [BREAK]
            for row in rows[name]:
                codes += [*self.code(row).tolist(), BREAK]
            edges = automaton(codes)
            dead = (base + len(edges)) * self.width  # behind a sign that never occurs, which is a phrase of its own
            part = np.full((len(edges) + 1, self.width), -1, np.int32)
            for state, out in enumerate(edges):
                for code, target in out.items():
                    if code < self.width:
                        part[state, code] = (base + target) * self.width
                    else:
                        keys.append((base + state) * self.span + code)
                        targets.append((base + target) * self.width)
            first = np.where(part[0] < 0, dead, part[0]).astype(np.int32)
            missing = part < 0
            part[missing] = np.broadcast_to(first | _FLAG, part.shape)[missing]
            part[0] = first
            part[:, PAD] = base * self.width
            parts.append(part)
            roots.append(base * self.width)
            weights.append(math.log2(len(codes) + 1))
            base += len(edges) + 1
        self.table = np.concatenate([p.ravel() for p in parts]) if parts else np.zeros(0, np.int32)
        self.roots, self.weights = np.array(roots, np.int32), np.array(weights)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.targets = np.array(keys, np.int64)[order], np.array(targets, np.int32)[order]

    def code(self, letters: np.ndarray) -> np.ndarray:
        if not len(self.alphabet):
            return np.where(letters == 0, BREAK, UNSEEN)
        place = np.minimum(np.searchsorted(self.alphabet, letters), len(self.alphabet) - 1)
        return np.where(letters == 0, BREAK, np.where(self.alphabet[place] == letters, self.codes[place], UNSEEN))

    def _edge(self, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next rows over letters without a column, and whether there is such an edge."""
        wanted = state.astype(np.int64) // self.width * self.span + codes
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return self.targets[place], self.keys[place] == wanted

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (of codes) by language: a row per text."""
        strips = [max(1, -(-len(t) // STRIP)) for t in texts]
        lanes = np.full((sum(strips), STRIP), PAD, np.int32)
        flat, at = lanes.reshape(-1), 0
        for text, n in zip(texts, strips, strict=True):
            flat[at * STRIP : at * STRIP + len(text)] = text
            at += n
        steps = np.ascontiguousarray(lanes.T)
        roots = np.repeat(self.roots[:, None], len(lanes), axis=1)
        state, count = roots, np.ones(roots.shape, np.int32)
        for codes in steps:
            rare = np.flatnonzero(codes >= self.width) if self.span > self.width else ()
            if len(rare):
                codes, sparse = np.where(codes < self.width, codes, UNSEEN), codes[rare]
                (ahead, on), (fresh, known) = self._edge(state[:, rare], sparse), self._edge(roots[:, rare], sparse)
            after = self.table.take(state + codes)
            if len(rare):
                after[:, rare] = np.where(on, ahead, np.where(known, fresh | _FLAG, after[:, rare]))
            count += after >> 30
            state = after & (_FLAG - 1)
        return np.add.reduceat(count, np.cumsum([0, *strips[:-1]]), axis=1).T

    def costs(self, texts: list[str]) -> np.ndarray:
        """Normalised phrases of each text by language: bits per letter. A text without a
        letter gives a row of infinities."""
        letters = [letters_of(text) for text in texts]
        out = np.full((len(texts), len(self.languages)), np.inf)
        able = [k for k, row in enumerate(letters) if row.any()]
        if able and self.languages:
            found = self.phrases([self.code(letters[k]) for k in able])
            out[able] = found * self.weights / np.array([[len(letters[k])] for k in able])
        return out


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = ROWS) -> Model:
    """Automata from a bounded sample: per language ``rows`` distinct texts by the order of
    their hash, of each ``ROW_CHARS`` characters, up to ``CHARS`` per language and
    ``ALL_CHARS`` together. Rows with a null text or language are left out."""
    texts = pick(labelled, text=text_col, lang=lang_col).filter("text is not null and lang is not null")
    texts = texts.select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(1 << 30)).alias("h"))
    # Distinct texts, not rows: copies add none to the sample. The cut-off only saves work; a
    # language that ends short of texts is read again with a wider one, down to none.
    counts = {r["lang"]: max(1, r["n"]) for r in texts.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return Model({})
    top = 1 << 30
    cut = {name: int(min(1.0, 8 * rows / n) * top) for name, n in counts.items()}
    first: dict[str, list[str]] = {}
    while cut:
        share = F.element_at(F.create_map(*[F.lit(x) for pair in cut.items() for x in pair]), F.col("lang"))
        some = texts.filter(F.col("h") < share).select("lang", "h", F.substring("text", 1, ROW_CHARS).alias("text")).distinct()
        ranked = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("k") <= rows)
        first |= {name: [] for name in cut}
        for row in sorted(ranked.collect(), key=lambda r: (r["lang"], r["k"])):
            first[row["lang"]].append(row["text"])
        cut = {name: min(top, 8 * max(1, n)) for name, n in cut.items() if n < top and len(first[name]) < rows}
    samples: dict[str, list[str]] = {}
    for name, found in first.items():
        room = min(CHARS, ALL_CHARS // len(counts))
        for text in found:
            text = text[:room]
            room -= len(text)
            if text:
                samples.setdefault(name, []).append(text)
    return Model(samples)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred, score, bits`` for every row, from whole texts.

    ``score`` is the second-best language's share of the two best costs (0.5: a tie, 1: no
    other language); ``bits`` the winner's cost per letter. A null text or one without a
    letter is ``und`` with score 0 and null bits, as is every text of a model without
    languages. Ties go to the first name. Repeated rows are judged each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # bounded by ALL_CHARS

    def judge(texts: list[str]) -> list[tuple]:
        tool: Model = restored(Model, shared.value)
        out = []
        for costs in tool.costs(texts):
            if not len(costs) or np.isinf(costs[0]):
                out.append((UNKNOWN, 0.0, None))
                continue
            order = np.argsort(costs, kind="stable")
            best = float(costs[order[0]])
            second = float(costs[order[1]]) if len(order) > 1 else math.inf
            out.append((tool.languages[order[0]], 1.0 if math.isinf(second) else second / (best + second), best))
        return out

    return annotate(docs, judge, "lang_pred string, score double, bits double", text_col, BATCH_CHARS)
