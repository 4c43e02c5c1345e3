"""Operator 6, toxicity: a weighted finite-state pattern grammar over clauses.

A lexicon maps words to symbols (insult, threat, target, negation, report, vow, other) with weights: fixed seed words, and
word stems that labelled text marks as insulting. Five transducers read the symbols of a clause one after the other, each the
output of the one before, and add marks:

* ``Negation``: insults and threats up to ``REACH`` words after a negation word are negated,
* ``Reported``: those after a reporting word or a quotation mark, up to the clause's end, are reported,
* ``Target``: insults up to ``REACH`` words after a target word are aimed; a target up to ``REACH`` words after an insult
  aims it afterwards,
* ``Insult``: each insult is an event (aimed, negated, reported),
* ``Threat``: a threat word with a target among the next ``THREAT_REACH`` words is an event (vowed, negated, reported); it is
  vowed up to ``VOW_REACH`` words after a word that announces ("will", "deserve").

``Composition`` is their product as one table (state, symbol) -> (state, effects), made when a pair first comes up; a clause
is scored by following it. Events carry the weight of their insult or threat word, and a document's score is a logistic
function of the logarithms of its events' summed weights, fitted on labelled text. Only clauses that hold a lexicon word are
followed; they are found in whole texts by an Aho-Corasick scan.

Training reads a bounded hash sample, ``PER_CLASS`` labelled documents a class, written once and read from there.

Defined results: a null text counts as empty; texts without a match all get the same low score; without labels of both
classes the prior weights of the seeds alone decide; labels that are null or not 0 or 1 are ignored, of several labels of an
id the higher counts, and of several texts of an id the least is learned from; of stems that fit a word the longest decides;
repeated rows get the same score; a text of any length is scanned clause by clause; an empty table gives no rows; an input
column with the score's name gives way to it.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from .common import append_columns
from .quality import fit_logistic, labelled_texts, logistic, sampled

PER_CLASS, REACH, THREAT_REACH, VOW_REACH = 4000, 3, 2, 4
#: A stem is learned if so large a share of its contexts is toxic, and so many of them that chance would give it once in
#: e ** EVIDENCE stems.
LEAST_SHARE, EVIDENCE = 0.8, 10.0
SEED_WEIGHT = 3.0

# fixed values: seed words, threats by how grave they are
INSULTS = "idiot idiots moron morons stupid loser losers scum trash clown clowns pathetic worthless disgusting imbecile dumb vermin bastard bitch asshole arschloch dummkopf trottel abschaum imbécile crétin connard ordure estúpido imbécil escoria idiota gilipollas".split()
THREATS = {3.0: "kill murder shoot stab töten umbringen tuer matar".split(), 2.0: "destroy burn hurt vernichten détruire destruir".split(), 1.5: "beat frapper golpear".split()}
TARGETS = "you your yours yourself he she they him her du dich euch ihr vous toi te tu ti usted ustedes ellos".split()
NEGATIONS = "not no never none isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais aucun nunca jamás ni".split()
REPORTS = "said says say called calls quoted reported wrote claimed sagte sagt nannte schrieb dit disait écrit appelé dijo dice llamó escribió".split()
VOWS = "will i'll we'll gonna going shall must should deserve deserves werde werden soll sollen verdient vais allons doit mérite voy vamos debe merece".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, VOW = range(7)
#: Events: an insult by (aimed, negated, reported), a threat by (vowed, negated, reported).
EVENTS = [(kind, a, n, r) for kind in ("insult", "threat") for a in (0, 1) for n in (0, 1) for r in (0, 1)]
AT = {e: i for i, e in enumerate(EVENTS)}
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»]")
_CLAUSE_END = re.compile(r"[.!?;\n]")


class Sign(NamedTuple):
    """A symbol with the marks that transducers have set so far. effects: ("insult", event), ("aim", event before, event
    after) or ("threat", event), to be given the weight of this insult, the last loose one, or the last threat word."""

    kind: int
    negated: int = 0
    reported: int = 0
    aimed: int = 0
    effects: tuple = ()


class Negation:
    start = 0

    @staticmethod
    def step(left: int, sign: Sign) -> tuple[int, Sign]:
        if sign.kind == NEGATION:
            return REACH, sign
        return max(0, left - 1), sign._replace(negated=int(left > 0)) if sign.kind in (INSULT, THREAT) else sign


class Reported:
    start = 0

    @staticmethod
    def step(said: int, sign: Sign) -> tuple[int, Sign]:
        return int(said or sign.kind == REPORT), sign._replace(reported=said) if sign.kind in (INSULT, THREAT) else sign


class Target:
    """State: words left in which an insult is aimed; words left in which a target aims the last loose insult, and its marks."""

    start = (0, 0, None)

    @staticmethod
    def step(state: tuple, sign: Sign) -> tuple[tuple, Sign]:
        left, waits, marks = state
        after = (max(0, left - 1), waits - 1, marks) if waits > 1 else (max(0, left - 1), 0, None)
        if sign.kind == TARGET:
            if waits:
                sign = sign._replace(effects=(*sign.effects, ("aim", AT["insult", 0, *marks], AT["insult", 1, *marks])))
            return (REACH, 0, None), sign
        if sign.kind == INSULT:
            if left:
                return (after[0], 0, None), sign._replace(aimed=1)
            return (after[0], REACH, (sign.negated, sign.reported)), sign
        return after, sign


class Insult:
    start = ()

    @staticmethod
    def step(state: tuple, sign: Sign) -> tuple[tuple, Sign]:
        if sign.kind == INSULT:
            sign = sign._replace(effects=(*sign.effects, ("insult", AT["insult", sign.aimed, sign.negated, sign.reported])))
        return state, sign


class Threat:
    """State: words left in which a threat is vowed; words left in which a target makes the last threat word one, its marks."""

    start = (0, 0, None)

    @staticmethod
    def step(state: tuple, sign: Sign) -> tuple[tuple, Sign]:
        left, waits, marks = state
        after = (max(0, left - 1), waits - 1, marks) if waits > 1 else (max(0, left - 1), 0, None)
        if sign.kind == VOW:
            return (VOW_REACH, *after[1:]), sign
        if sign.kind == THREAT:
            return (after[0], THREAT_REACH, (int(left > 0), sign.negated, sign.reported)), sign
        if sign.kind == TARGET and waits:
            return (after[0], 0, None), sign._replace(effects=(*sign.effects, ("threat", AT["threat", *marks])))
        return after, sign


class Composition(dict):
    """The transducers' product: (state, symbol) -> (state, effects), a state being one of each; entries are made on demand."""

    def __init__(self, *machines: type):
        super().__init__()
        self.machines, self.start = machines, tuple(m.start for m in machines)

    def __missing__(self, key: tuple) -> tuple:
        states, sign = key[0], Sign(key[1])
        after = []
        for machine, state in zip(self.machines, states, strict=True):
            state, sign = machine.step(state, sign)
            after.append(state)
        self[key] = (tuple(after), sign.effects)
        return self[key]


@functools.lru_cache(maxsize=1)
def composed() -> Composition:
    return Composition(Negation, Reported, Target, Insult, Threat)


class Grammar:
    """The lexicon and the composed transducers. stems: stem -> weight; words: seed word -> (symbol, weight)."""

    def __init__(self, stems: dict[str, float]):
        import ahocorasick

        self.stems = stems
        threats = {w: grave for grave, words in THREATS.items() for w in words}
        groups = [(INSULT, dict.fromkeys(INSULTS, SEED_WEIGHT)), (THREAT, threats), *((kind, dict.fromkeys(words, 0.0)) for kind, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (VOW, VOWS)))]
        self.words = {w: (kind, weight) for kind, words in groups for w, weight in words.items()}
        self.table = composed()
        self.scan = ahocorasick.Automaton()
        for w in {*INSULTS, *threats, *stems}:
            self.scan.add_word(w, len(w))
        self.scan.make_automaton()
        self.lengths = sorted({len(s) for s in stems}, reverse=True)

    def classify(self, word: str) -> tuple[int, float]:
        if (known := self.words.get(word)) is not None:
            return known
        for n in self.lengths:
            if (weight := self.stems.get(word[:n])) is not None and len(word) >= n:
                return INSULT, weight
        return (REPORT, 0.0) if word in '"“”«»' else (OTHER, 0.0)

    def clauses(self, text: str) -> list[str]:
        """The clauses that hold a lexicon word, which must start at a word's start."""
        out, done = [], -1
        for last, n in self.scan.iter(text):
            start = last - n + 1
            if start < done or start and (text[start - 1].isalpha()):
                continue
            a = max(text.rfind(c, 0, start) for c in ".!?;\n") + 1
            found = _CLAUSE_END.search(text, last)
            done = found.start() if found else len(text)
            out.append(text[a:done])
        return out

    def walk(self, clause: str) -> np.ndarray:
        """Summed weights by event: the table followed over the clause's symbols."""
        total, state, loose, grave = np.zeros(len(EVENTS)), self.table.start, 0.0, 0.0
        for word in _TOKEN.findall(clause):
            kind, weight = self.classify(word)
            state, effects = self.table[state, kind]
            for effect in effects:
                if effect[0] == "insult":
                    total[effect[1]] += weight
                elif effect[0] == "aim":
                    total[effect[1]] -= loose
                    total[effect[2]] += loose
                else:
                    total[effect[1]] += grave
            if kind == INSULT:
                loose = weight
            elif kind == THREAT:
                grave = weight
        return total

    def features(self, text: str | None) -> np.ndarray:
        """Logarithms of one and the events' weights, and of one and all weights."""
        total = np.zeros(len(EVENTS))
        for clause in self.clauses((text or "").lower()):
            total += self.walk(clause)
        return np.log1p(np.maximum(0.0, np.append(total, total.sum())))


#: Weights before any labels: aimed insults and vowed threats count most, negated and reported ones least.
PRIOR = np.array([-4.0] + [((2.6 if a else 1.6) if kind == "threat" else 1.6 + 0.6 * a) * (0.3 if n else 1) * (0.3 if r else 1) for kind, a, n, r in EVENTS] + [0.6])


def learn_stems(rows: DataFrame) -> dict[str, float]:
    """rows: __text, __y. Stems that toxic documents hold; the shortest that qualify, with log-odds as weights.

    What counts is distinct pairs of a word and the one before it, so that copies of a document count once.
    """
    words = F.regexp_extract_all(F.lower("__text"), F.lit(r"(\p{L}+)"), F.lit(1))
    pairs = rows.select("__y", words.alias("ws")).select("__y", F.explode(F.arrays_zip(F.concat(F.array(F.lit("")), F.col("ws")).alias("a"), F.col("ws").alias("b"))).alias("p"))
    pairs = pairs.select("__y", F.col("p.a").alias("a"), F.col("p.b").alias("w")).where("length(w) >= 4").distinct()
    words = pairs.groupBy("w").agg(F.sum("__y").alias("t"), F.sum(1 - F.col("__y")).alias("c"))
    stems = words.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(4), F.lit(9)), lambda n: F.substring("w", F.lit(1), n)))).alias("s"), "t", "c")
    stems = stems.groupBy("s").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    totals = words.agg(F.sum("t"), F.sum("c")).first()
    share = (totals[0] or 1) / max(1, (totals[0] or 1) + (totals[1] or 1))
    least = EVIDENCE / -np.log(min(0.99, share))
    found = stems.where((F.col("t") >= float(least)) & (F.col("t") >= LEAST_SHARE * (F.col("t") + F.col("c")))).collect()  # of a bounded sample
    out: dict[str, float] = {}
    total = {r["s"]: (r["t"], r["c"]) for r in found}
    for s in sorted(total, key=lambda s: (len(s), s)):
        if not any(s[:n] in out for n in range(4, len(s) + 1)) and not any(x.startswith(s) for x in out):
            while longer := [x for x in total if len(x) == len(s) + 1 and x[:-1] == s and total[x][0] >= 0.9 * total[s][0]]:
                s = longer[0]  # nearly all of its words go on alike: the longer stem says the same and errs less
            t, c = total[s]
            out[s] = float(np.log((t + 0.5) / (c + 0.5)))
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> dict:
    """The learned stems and the events' weights."""
    rows = labelled_texts(docs, sampled(labels, label, per_class, 3, id_col), id_col, text_col, "toxic")
    stems = learn_stems(rows)
    columns = [StructField(f"e{i}", DoubleType()) for i in range(len(EVENTS) + 1)]

    def make():
        grammar = Grammar(stems)
        return lambda texts: [pa.array(c, pa.float64()) for c in np.array([grammar.features(t) for t in texts]).reshape(-1, len(EVENTS) + 1).T]

    seen = append_columns(rows, "__text", make, columns, keep=["__id", "__y"]).collect()  # 2 * PER_CLASS rows of a few numbers
    seen.sort(key=lambda r: r["__id"])
    y = np.array([r["__y"] for r in seen], float)
    x = np.array([[r[c.name] for c in columns] for r in seen]).reshape(-1, len(columns))
    if len(set(y)) < 2:
        return {"stems": stems, "model": (np.zeros(len(columns)), np.ones(len(columns)), PRIOR)}
    return {"stems": stems, "model": fit_logistic(x, y, 1e-4, PRIOR)}


def score(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Adds the score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # stems of a bounded sample and a few weights

    def make():
        m = shared.value
        grammar = Grammar(m["stems"])
        empty = float(logistic(np.zeros((1, len(EVENTS) + 1)), m["model"])[0])

        def compute(texts: list) -> list[pa.Array]:
            x = np.array([grammar.features(t) for t in texts]).reshape(-1, len(EVENTS) + 1)
            s = np.full(len(texts), empty)
            hit = x.any(axis=1)
            s[hit] = logistic(x[hit], m["model"])
            return [pa.array(s, pa.float64())]

        return compute

    return append_columns(docs, text_col, make, [StructField(name, DoubleType())], keep)
