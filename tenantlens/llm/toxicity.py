"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tenantlens.llm.common import HELD_OUT, fold, stage, table

THRESHOLD = 0.3
SAMPLE = 16_000  # labelled documents the grammar is fitted on
STEMS = 4_000  # learned arcs at most
STEM_LENGTHS = (4, 5, 6, 7, 8)
WHOLE = "$"  # ends a stem that is a whole word
ALPHA = 0.1

# General words of abuse and the words that shape a clause, in the four languages of the corpus.
INSULTS = """idiot idiots moron morons imbecile stupid dumb loser losers pathetic worthless disgusting scum trash garbage clown
 clowns freak freaks jerk bastard filth filthy vermin scumbag dimwit fool fools coward pig pigs useless ugly creep parasite
 dummkopf vollidiot versager abschaum trottel arschloch widerlich erbaermlich imbécile crétin débile ordure salaud minable
 abruti idiote imbécil estúpido estúpida basura asqueroso patético inútil cabrón gilipollas"""
THREATS = """kill murder hurt destroy beat stab shoot strangle burn slaughter töten umbringen vernichten verprügeln tuer
 massacrer frapper détruire matar destruir golpear asesinar"""
YOU = "you your yours yourself du dir dein deine ihr tu toi vous votre ton usted ustedes vosotros tus"
PERSONS = "he she they him them his her their er sie il elle ils él ella ellos"
CLITICS = "dich euch ihn te os"  # objects that stand before the verb
SELVES = "i we i'm i'll we'll ich wir je nous yo nosotros"
MODALS = "will shall should must gonna going werde werden sollte vais allons voy vamos"
NEGATIONS = """not never no nobody isn't aren't wasn't weren't don't doesn't didn't won't can't nicht kein keine nie ne jamais aucun
 nunca jamás ningún"""
TURNS = "but however yet though aber sondern doch mais pourtant pero sino"
REPORTS = "said says say told claimed called quoted reported wrote sagte schrieb behauptete dit disait écrit dijo dice escribió"

SYMBOLS = 14
(OTHER, INSULT, THREAT, SECOND, PERSON, CLITIC, SELF, MODAL, NEGATION, TURN, REPORT, PAUSE, QUOTE, STOP) = range(SYMBOLS)
BREAK = SYMBOLS  # end of a line or of the text; closes what a full stop leaves open
READ = SYMBOLS + 1
# What a machine writes for an insult or a threat: the symbol shifted by its state; direct, reported, negated, both.
DIRECT, REPORTED, NEGATED = 0, 1, 2
REACH = 2  # words between a threat and its target at most
DISCOUNT = (1.0, 0.1, 0.1, 0.05)
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.,;:!?\n\"“”„«»]")


def _shaded(symbol: int, code: int) -> int:
    """Insult or threat of a code (0 to 3) on a tape between two machines."""
    return symbol if code == 0 else READ + 3 * (symbol - INSULT) + code - 1


def _plain(symbol: int) -> tuple[int, int]:
    """Symbol and code of what stands on a tape."""
    return (symbol, 0) if symbol < READ else (INSULT + (symbol - READ) // 3, (symbol - READ) % 3 + 1)


TAPE = READ + 6


@dataclass
class Transducer:
    """State s reads symbol a: goes to ``step[s, a]``, writes ``emit[s, a]``, multiplies by ``weight[s, a]``. Starts in 0."""

    step: np.ndarray
    emit: np.ndarray
    weight: np.ndarray

    @staticmethod
    def build(start, rule, symbols: int) -> Transducer:
        """Machine of the states that ``rule(state, symbol) -> (state, written, weight)`` reaches from ``start``."""
        names, table = {start: 0}, []
        for state in (queue := [start]):
            row = [rule(state, a) for a in range(symbols)]
            for after, _, _ in row:
                if after not in names:
                    names[after] = len(names)
                    queue.append(after)
            table.append([(names[after], written, w) for after, written, w in row])
        cube = np.array(table, dtype=float)
        return Transducer(cube[:, :, 0].astype(np.int32), cube[:, :, 1].astype(np.int32), cube[:, :, 2])

    def compose(self, other: Transducer) -> Transducer:
        """``other`` reads what this machine writes; weights multiply."""
        def rule(state, a):
            s, t = state
            written = self.emit[s, a]
            return ((int(self.step[s, a]), int(other.step[t, written])), int(other.emit[t, written]),
                    float(self.weight[s, a] * other.weight[t, written]))
        return Transducer.build((0, 0), rule, self.step.shape[1])


def reported_speech() -> Transducer:
    """A report verb, unless the writer speaks of himself just before, opens reported speech.

    It holds over commas, colons and opening quotes to the full stop, or,
    once a quote is open, to its end; a line break ends it always. A report
    that follows its quote is not seen.
    """
    def rule(state, a):
        if a == BREAK:
            return "direct", a, 1.0
        if a in (INSULT, THREAT) and state in ("reported", "quoted"):
            return state, _shaded(a, REPORTED), 1.0
        if state == "quoted":
            return ("direct" if a == QUOTE else state), a, 1.0
        if state == "reported":
            return {QUOTE: "quoted", STOP: "direct"}.get(a, state), a, 1.0
        if a == REPORT and state != "self":
            return "reported", a, 1.0
        return ("self" if a == SELF else "direct"), a, 1.0
    return Transducer.build("direct", rule, READ)


def negation() -> Transducer:
    """A negation covers what follows to the next turn word, pause, stop or break, and nothing before it."""
    def rule(covered, a):
        symbol, code = _plain(a)
        if symbol in (INSULT, THREAT) and covered:
            return covered, _shaded(symbol, code | NEGATED), 1.0
        return (True if a == NEGATION else covered and a not in (TURN, PAUSE, STOP, BREAK)), a, 1.0
    return Transducer.build(False, rule, TAPE)


def clause() -> Transducer:
    """Insults and threats of a clause; written where it ends, with the discount of its strongest part.

    An insult is aimed if the clause names a person. A threat needs an agent
    before it (the writer or a modal verb) and a target at most ``REACH``
    words behind it, or an object before it; without an agent, at the start
    of a clause, only the addressed person is a target. Written: 0, or
    insult part (bare 1-4, aimed 5-8) x 5 + threat part (1-4).
    """
    def rule(state, a):
        agent, named, insult, threat, wait = state  # threat: 0 or 1 + code; wait: None or (words left, code, is an order)
        symbol, code = _plain(a)
        if symbol in (PAUSE, STOP, BREAK):
            part = insult + (4 if insult and named else 0)
            strongest = max([DISCOUNT[x - 1] for x in (insult, threat) if x], default=1.0)
            return ("start", False, 0, 0, None), part * 5 + threat, strongest
        if wait is not None and symbol in ((SECOND, CLITIC) if wait[2] else (SECOND, PERSON, CLITIC)):
            threat, wait = wait[1] + 1, None
        elif wait is not None and symbol != QUOTE:
            wait = (wait[0] - 1, *wait[1:]) if wait[0] else None
        if symbol == CLITIC and agent == "agent":
            agent = "aimed"
        named = named or symbol in (SECOND, PERSON, CLITIC)
        if symbol == INSULT:
            insult = min(insult or 5, code + 1)
        elif symbol == THREAT and not threat:
            if agent == "aimed":
                threat, wait = code + 1, None
            elif agent in ("agent", "start"):
                wait = (REACH, code, agent == "start")
        if symbol in (SELF, MODAL):
            agent = agent if agent == "aimed" else "agent"
        elif agent == "start" and symbol != QUOTE:
            agent = "none"
        return (agent, named, insult, threat, wait), 0, 1.0
    return Transducer.build(("start", False, 0, 0, None), rule, TAPE)


def grammar() -> Transducer:
    """Words' symbols through reported speech, then negation, then clauses."""
    return reported_speech().compose(negation()).compose(clause())


KINDS = 12  # bare insults, aimed insults, threats; each direct, reported, negated, both
FEATURES = KINDS + 3


@dataclass
class Model:
    """Arcs of the lexical transducer, grammar weights of the matched clauses, offset."""

    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = None
    bias: float = -3.0

    def __post_init__(self):
        if self.weights is None:
            self.weights = prior()
        words = {INSULT: INSULTS, THREAT: THREATS, SECOND: YOU, PERSON: PERSONS, CLITIC: CLITICS, SELF: SELVES, MODAL: MODALS,
                 NEGATION: NEGATIONS, TURN: TURNS, REPORT: REPORTS}
        self.arcs = {w: (s, 1.0) for s, text in words.items() for w in text.split()}
        marks = {PAUSE: ",:", QUOTE: '"“”„«»', STOP: ".;!?", BREAK: "\n"}
        self.arcs |= {p: (s, 0.0) for s, text in marks.items() for p in text}
        self.fst = grammar()


class Lexicon(dict):
    """Word to (symbol, weight); caches a bounded number of words. Holds the machine's tables as lists."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.step, self.emit, self.weight = (t.tolist() for t in (model.fst.step, model.fst.emit, model.fst.weight))

    def __missing__(self, word: str):
        arc = self.model.arcs.get(word.replace("’", "'"), (OTHER, 0.0))
        weight = max(self.model.stems.get(s, 0.0) for s in beginnings(word))
        if weight and arc[0] in (OTHER, INSULT):  # a learned stem
            arc = (INSULT, max(weight, arc[1]))
        if len(self) > 300_000:
            self.clear()
        self[word] = arc
        return arc


def prior() -> np.ndarray:
    """Weights before any label: abuse counts, aimed abuse more, threats most, reported or negated ones hardly."""
    kinds = [max(w * d, 0.0) for w in (1.2, 1.8, 2.4) for d in DISCOUNT]
    return np.array(kinds + [0.5, 0.5, 0.0])


def clause_features(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """Matched clauses of each kind (log1p), their summed weight (log1p), discounted matches per 100 words (log1p), log words.

    A matched clause weighs its heaviest word times the discount that the
    machine puts on the arc that ends it.
    """
    x = np.zeros(FEATURES)
    tokens = _TOKEN.findall(text.lower()) if text else []
    arcs = list(map(lexicon.__getitem__, tokens))
    if any(a[0] == INSULT or a[0] == THREAT for a in arcs):
        step, emit, weight = lexicon.step, lexicon.emit, lexicon.weight
        state, heaviest, total, matches = 0, 0.0, 0.0, 0.0
        for symbol, heavy in arcs + [(BREAK, 0.0)]:
            if heavy > heaviest and symbol <= THREAT:
                heaviest = heavy
            if symbol >= PAUSE:
                if out := emit[state][symbol]:
                    insult, threat = divmod(out, 5)
                    if insult:
                        x[insult - 1] += 1
                    if threat:
                        x[8 + threat - 1] += 1
                    total += heaviest * weight[state][symbol]
                    matches += weight[state][symbol]
                if symbol != QUOTE:
                    heaviest = 0.0
            state = step[state][symbol]
        x[:KINDS] = np.log1p(x[:KINDS])
        x[-3], x[-2] = np.log1p(total), np.log1p(100 * matches / max(1, len(tokens)))
    x[-1] = np.log1p(len(tokens)) / 10
    return x


def beginnings(word: str) -> list[str]:
    return [word[:n] for n in STEM_LENGTHS if len(word) >= n] + [word + WHOLE]


def learn_stems(sample: DataFrame, alpha: float = ALPHA, most: int | None = STEMS) -> dict[str, float]:
    """Word beginnings and whole words that toxic documents have and others lack, with weights (at most 2).

    Each beginning counts once per distinct text. One is kept if its
    log-likelihood ratio exceeds the logarithm of candidates / alpha, so that
    chance beginnings are not expected among the thousands tried.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            met, toxic = Counter(), Counter()
            for text, y in zip(b["text"], b["toxic"]):
                stems = {s for w in {w for w in _TOKEN.findall(text.lower()) if len(w) >= STEM_LENGTHS[0]} for s in beginnings(w)}
                met.update(stems)
                if y:
                    toxic.update(stems)
            yield pd.DataFrame([(s, toxic[s], n) for s, n in met.items()], columns=["stem", "p", "n"])

    totals = sample.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    pos, rows = int(totals[0] or 0), int(totals[1])
    if not 0 < pos < rows:
        return {}
    base = pos / rows
    counts = stage(sample.mapInPandas(run, "stem string, p long, n long").groupBy("stem").agg(F.sum("p").alias("p"), F.sum("n").alias("n")))
    tried = counts.count()
    share = F.col("p") / F.col("n")
    ratio = F.col("p") * F.log(share / base) + F.when(F.col("p") < F.col("n"), (F.col("n") - F.col("p")) * F.log((1 - share) / (1 - base))).otherwise(0)
    best = counts.where((F.col("p") >= 4) & (share > 0.8)).withColumn("ratio", ratio).where(F.col("ratio") > float(np.log(tried / alpha)))
    ranked = best.orderBy(F.desc("ratio"), "stem")
    kept = (ranked if most is None else ranked.limit(most)).collect()
    odds = {r.stem: min(5.0, float(np.log((r.p + .5) / (r.n - r.p + .5) * (1 - base) / base))) for r in kept}
    stems: dict[str, float] = {}
    for stem, w in odds.items():  # by falling ratio: of a word's beginnings only the most telling one
        if not any(stem[:n] in stems for n in STEM_LENGTHS) and not any(k.startswith(stem) for k in stems):
            stems[stem] = w / 2.5
    return stems


def _fit(x: np.ndarray, y: np.ndarray, start: np.ndarray, bias: float, l2: float = 2.0, turns: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, pulled towards the prior weights."""
    full, centre = np.c_[x, np.ones(len(x))], np.append(start, bias)
    w, pull = centre.copy(), np.append(np.full(len(start), l2), 1e-3)
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        grad = full.T @ (p - y) + pull * (w - centre)
        step = np.linalg.solve(full.T @ (full * (p * (1 - p) + 1e-9)[:, None]) + np.diag(pull), grad)
        w = w - step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, most: int | None = STEMS) -> Model:
    """Fit on about ``sample`` labelled rows outside the held-out fold, chosen by hash of the id, equal texts once.

    Stems are learned on four fifths of the sample; the clause weights on the
    rest, where the stems were not chosen. Equal texts count once, as toxic if
    one of them is. At most ``most`` stems are kept (None: all). Without labels
    of both kinds the model keeps its prior weights.
    """
    truth = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = stage(docs.where(fold(F.col("doc_id")) != HELD_OUT).select("doc_id").join(truth, "doc_id").distinct().withColumn("turn", F.xxhash64("doc_id")))
    share = min(1.0, sample / max(1, known.count()))
    picked = stage(known.where(F.pmod(F.col("turn"), F.lit(1 << 30)) < int(share * (1 << 30))))
    # some 16 bytes for each of about ``sample`` rows: small enough to broadcast, so no other text moves
    chosen = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    part = F.pmod(F.shiftright("turn", 32), F.lit(5))
    chosen = stage(chosen.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min(part).alias("part")))
    model = Model(learn_stems(chosen.where("part < 4"), most=most))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(model)
        for b in batches:
            yield pd.DataFrame({"x": [clause_features(t, lexicon) for t in b["text"]], "toxic": b["toxic"]})

    rest = chosen.where("part = 4").select("text", "toxic").mapInPandas(run, "x array<double>, toxic int").toPandas()
    if rest["toxic"].nunique() == 2:
        x, y = np.stack(rest["x"]), rest["toxic"].to_numpy(float)
        model.weights, model.bias = _fit(x, y, prior(), float(np.log(y.mean() / (1 - y.mean()))))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.3) added or replaced.

    The score reads the text alone. Null, empty and wordless texts get the
    score of a text without matched clauses.
    """
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(model)
        for b in batches:
            x = np.array([clause_features(t, lexicon) for t in b]).reshape(-1, FEATURES)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ model.weights + model.bias, -30, 30))))

    out = docs.withColumn("score", scored(F.col("text")))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7_clause_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", "predicted")


QUERIES = {"op7_clause_toxicity": op7_clause_toxicity}
