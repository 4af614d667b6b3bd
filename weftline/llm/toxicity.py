"""Toxicity by a weighted finite-state pattern grammar.

Words are read as classes (insult, threat, target, negation, report, copula, pause, ...). Transducers for reported
speech and mentions, negation, targets, frames (a copula before the insult, an address set off by a pause, insults in a
row) and threats are composed into one machine that is run over each clause that holds an insult or a threat. What
counts is the pattern that the clause matches, with a weight that is learned from labelled documents, as are the stems
of insults; a short general lexicon is always there. Before any label is seen, an insult without a pattern doesn't
decide, a negated or reported one weighs little, a framed or targeted one most.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import crc_mod, text_of
from weftline.llm.tokens import PieceCodec
from weftline.llm.transducers import Transducer
from weftline.session import materialize

FOLDS, HELD_OUT = 5, 0
#: The fit: labelled documents of each class at most, documents with a stem at least, odds over the other class.
SAMPLE, LEAST_DOCS, LEAST_ODDS = 5000, 3, 20.0
SHORTEST, LONGEST = 4, 9
#: Score of a text without any match.
NONE = 0.02
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_matches int, n_composed int"

# fixed values: a general lexicon, by class; a stem stands for every word that begins with it, unless it ends in $
INSULTS = (
    "idiot moron$ morons$ imbecile$ scum$ scumbag loser$ losers$ pathetic$ worthless$ stupid$ dumbass asshole bastard bitch$ retard$ cretin"
    " dipshit fuckwit degenerate$ wichser arschloch hurensohn schlampe drecksau vollidiot salaud$ connard conasse enculé abruti"
    " gilipollas pendejo cabrón hijoputa imbécil"
).split()
THREATS = "kill$ murder$ hurt$ stab$ shoot$ strangle$ beat$ destroy$ rape$ umbringen$ töten$ matar$ matarte$ tuer$".split()
TARGETS = "you$ your$ you're$ youre$ u$ he$ she$ they$ him$ her$ them$ these$ those$ du$ dich$ ihr$ tu$ te$ usted$ ustedes$ toi$ vous$".split()
FUTURES = "will$ gonna$ going$ i'll$ we'll$ werde$ werden$ voy$ vamos$ vais$ allons$ should$ must$".split()
NEGATIONS = "not$ never$ isn't$ aren't$ wasn't$ weren't$ don't$ nobody$ hardly$ nicht$ kein$ keine$ jamais$ nunca$".split()
COPULAS = "is$ are$ am$ was$ were$ be$ being$ been$ call$ called$ you're$ he's$ she's$ ist$ sind$ bist$ war$ est$ es$ eres$ sont$ sois$ son$".split()
DETERMINERS = "a$ an$ the$ such$ so$ very$ really$ just$ that$ ein$ eine$ einen$ der$ die$ das$ un$ une$ una$ le$ la$ el$ tan$ si$ sehr$".split()
REPORTS = (
    "said$ says$ wrote$ writes$ quoted$ quote$ reported$ reportedly$ allegedly$ claimed$ claims$ word$ words$ term$ means$"
    " sagte$ schrieb$ wort$ dijo$ escribió$ palabra$ déclaré$ écrit$ mot$"
).split()
QUOTES = frozenset("\"“”„«»‘'")

CLASSES = {"D": DETERMINERS, "B": COPULAS, "H": THREATS, "Y": TARGETS, "F": FUTURES, "N": NEGATIONS, "R": REPORTS}
#: What the machine reads: the classes, I for an insult, K for a quotation mark, V for another pause, O for any other word, $ for the end.
SYMBOLS = "IHYFNBDRKVO$"
CLAUSE = re.compile(r"[^.!?;:\n]+")
#: A word, or a pause between words: what sets off an address or an apposition.
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[^\w\s]+")
# fixed values: insults that are ordinary words elsewhere; their weight alone is not enough
MILD = "trash$ garbage$ clown$ clowns$ disgusting$ dumb$ fool$ fools$ ugly$ liar$ jerk$ filth$ vermin$ pig$ pigs$ dummkopf trottel$ tonto$ idiota$ basura$ débile$".split()
#: Weights of the patterns before any label is seen, as shares of the stem's own, and how many documents that counts for.
PRIOR = {"lone": 0.45, "framed": 0.75, "targeted": 0.95, "negated": 0.12, "reported": 0.25}
STRENGTH = 10
#: Log weight of a complete threat.
THREAT = 3.0


def parts() -> dict[str, Transducer]:
    """The transducers, in the order in which they are composed: each reads what the one before writes."""
    report = {(s, "R"): (1, "R", 0.0) for s in (0, 1, 2)} | {(1, "I"): (1, "r", 0.0), (1, "H"): (1, "O", 0.0)}
    mention = {(0, "K"): (2, "K", 0.0), (2, "K"): (2, "K", 0.0), (2, "D"): (2, "D", 0.0), (2, "I"): (0, "r", 0.0)}
    negation = {(0, "N"): (1, "N", 0.0)} | {(1, s): (1, s, 0.0) for s in "NBD"} | {(1, "I"): (0, "n", 0.0), (1, "H"): (0, "O", 0.0)}
    reach = 4
    target = {(s, "Y"): (1, "Y", 0.0) for s in range(reach + 1)} | {(s, "I"): (s, "T", 0.0) for s in range(1, reach + 1)}
    # a future word, then a threat within two words, then a target within two words
    threat = {(s, "F"): (1, "F", 0.0) for s in range(7)} | {(s, "H"): (4, "H", 0.0) for s in (1, 2, 3)} | {(s, "Y"): (0, "X", THREAT) for s in (4, 5, 6)}
    return {
        "report": Transducer(report | mention, {2: 0}),
        "negation": Transducer(negation, {1: 0}),
        "target": Transducer(target, {s: s % reach + 1 if s < reach else 0 for s in range(1, reach + 1)}),
        "frame": frame(),
        "threat": Transducer(threat, {1: 2, 2: 3, 3: 0, 4: 5, 5: 6, 6: 0}),
    }


def frame() -> Transducer:
    """Writes f for an insult after a copula, with a determiner and one more word between at most; C for one right after
    another insult, which frames that one too; Q after an insult at a border of the clause or after a pause, if another
    border or pause follows: an address."""
    states = ("start", "copula", "near", "begun", "insult", "list", "pause", "set off")
    steps = {(s, "B"): ("copula", "B", 0.0) for s in ("", *states)}
    steps |= {("start", "D"): ("start", "D", 0.0), ("copula", "D"): ("copula", "D", 0.0), ("copula", "O"): ("near", "O", 0.0)}
    steps |= {(s, "V"): ("pause", "V", 0.0) for s in ("", "start", "copula", "near", "pause")} | {("pause", "D"): ("pause", "D", 0.0)}
    steps |= {(s, "I"): ("insult", "f", 0.0) for s in ("copula", "near")} | {("", "I"): ("insult", "I", 0.0)}
    steps |= {("start", "I"): ("begun", "I", 0.0), ("pause", "I"): ("set off", "I", 0.0)}
    steps |= {(s, "I"): ("insult", "C", 0.0) for s in ("begun", "insult", "list", "set off")}
    steps |= {(s, "V"): ("list", "Q", 0.0) for s in ("begun", "set off")} | {(s, "$"): ("", "Q", 0.0) for s in ("begun", "set off")}
    steps |= {("insult", "V"): ("list", "V", 0.0), ("list", "V"): ("pause", "V", 0.0), ("list", "D"): ("list", "D", 0.0)} | {(s, "D"): ("insult", "D", 0.0) for s in ("begun", "insult", "set off")}
    return Transducer(steps, dict.fromkeys(states, ""), start="start")


@cache
def grammar(without: str = "") -> Transducer:
    """The composed machine, perhaps without one of its parts. It writes n for a negated insult, r for a reported, T for a
    targeted and f for a framed one, I for any other, which Q after it (or C, itself an insult) makes framed too; X
    completes a threat and has a weight.
    """
    kept = [part for name, part in parts().items() if name != without]
    machine = kept[0]
    for part in kept[1:]:
        machine = machine.then(part, SYMBOLS + "rnTfQC")
    return machine


class Learned(dict):
    """Stems and their weights, with ``shares``, the weights of the patterns."""

    def __init__(self, stems=(), shares: dict[str, float] | None = None):
        super().__init__(stems)
        self.shares = shares or dict(PRIOR)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_mod(doc_id, FOLDS) == HELD_OUT, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """text, toxic and a number of labelled rows to learn from: about ``most`` of either class, those with the lowest hashes.

    A document with labels of both classes counts as toxic; rows without a label, an id or a text are left out.
    """
    doc_id = F.col("doc_id").cast("long")
    known = labels.select(doc_id.alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000))
    share = F.lit(0)
    for label, n in counts.items():
        share = F.when(F.col("toxic") == label, F.lit(min(1_000_000, int(1_000_000 * most / n)))).otherwise(share)
    known = known.where(order < share)
    texts = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # the sample's ids are few, so they go to the texts
    sample = texts.join(F.broadcast(known), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"), F.monotonically_increasing_id().alias("at"))
    return materialize(sample, "toxicity-sample")


def stems_of(text: Column) -> Column:
    """The different beginnings of a text's words, and the whole words with $."""
    found = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= SHORTEST))
    starts = F.transform(found, lambda w: F.concat(F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length(w), F.lit(LONGEST))), lambda k: F.substring(w, F.lit(1), k)), F.array(F.concat(w, F.lit("$")))))
    return F.array_distinct(F.flatten(starts))


def learn_stems(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Learned:
    """Stems that mark toxic documents, each with its weight in (0, 1), and the weights of the patterns they are in.

    Candidates are beginnings of words in ``LEAST_DOCS`` toxic sample documents at least and with odds of
    ``LEAST_ODDS`` over clean ones. Of these a greedy cover keeps those that explain ``LEAST_DOCS`` documents which no
    kept stem does, so the other words of a copied toxic text are not learned. What is collected is bounded by the
    sample. The weight of a pattern is the share of toxic ones among the documents with such a clause, as if there
    were as many of either class, starting from ``PRIOR``.
    """
    sample = labelled_sample(docs, labels, most)
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if toxic < LEAST_DOCS or not clean:
        return Learned()
    rows = sample.select("at", "toxic", F.explode(stems_of(F.col("text"))).alias("stem"))
    counts = rows.groupBy("stem").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"), F.collect_list(F.when(F.col("toxic") == 1, F.col("at"))).alias("holders"))
    odds = ((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("c") + 0.5) / (clean + 1))
    found = {r["stem"]: r for r in counts.where((F.col("t") >= LEAST_DOCS) & (odds >= LEAST_ODDS)).collect()}

    def weight(stem: str) -> float:
        rate_t, rate_c = (found[stem]["t"] + 0.5) / (toxic + 1), (found[stem]["c"] + 0.5) / (clean + 1)
        return rate_t / (rate_t + rate_c)

    stems = {s: weight(s) for s in cover({s: frozenset(r["holders"]) for s, r in found.items()})}
    stems |= {s: weight(s) for s in (*INSULTS, *MILD) if s in found and s not in stems}
    return Learned(stems, learn_shares(sample, Learned(stems), toxic, clean))


def cover(holders: dict[str, frozenset[int]]) -> list[str]:
    """Stems that explain all documents which ``LEAST_DOCS`` or more share, greedily those with the most first."""
    names, left, kept = sorted(holders), set().union(*holders.values()), []
    gain = lambda s: len(holders[s] & left)
    heap = [(-len(h), len(s), s) for s, h in holders.items()]
    heapq.heapify(heap)
    gone: set[str] = set()

    def extensions(stem: str) -> list[str]:
        at = bisect_left(names, stem)
        return names[at : bisect_left(names, stem + chr(0x10FFFF), at)]

    while heap:
        known, size, first = heapq.heappop(heap)
        top = 0 if first in gone else gain(first)
        if top < LEAST_DOCS:
            continue
        if top < -known:
            heapq.heappush(heap, (-top, size, first))
            continue
        # of beginnings that explain about as much, the longest of those that extend the first
        best = max((s for s in extensions(first) if s not in gone and gain(s) >= 0.9 * top), key=lambda s: (len(s), s))
        kept.append(best)
        left -= holders[best]
        gone.update(extensions(best))
        heapq.heappush(heap, (-gain(first), size, first))
    return kept


def learn_shares(sample: DataFrame, stems: Learned, toxic: int, clean: int) -> dict[str, float]:
    """The weight of each pattern by the sample's documents that have it in some clause."""
    bound = sample.sparkSession.sparkContext.broadcast(stems)

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        PieceCodec.release()
        scorer = Scorer(bound.value)
        for batch in batches:
            found = [(kind, label) for text, label in zip(pc.utf8_lower(batch.column(0)).to_pylist(), batch.column(1).to_pylist(), strict=True) for kind in {k for k, _ in scorer.matches(text)}]
            yield pa.record_batch([pa.array([k for k, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32())], ["kind", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(patterns, "kind string, toxic int").groupBy("kind").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect()
    seen = {r["kind"]: (r["t"], r["n"] - r["t"]) for r in rows}
    shares = {}
    for kind, prior in PRIOR.items():
        t, c = seen.get(kind, (0, 0))
        t, c = t * (toxic + clean) / (2 * toxic), c * (toxic + clean) / (2 * clean)
        shares[kind] = (STRENGTH * prior + t) / (STRENGTH + t + c)
    return shares


#: Patterns by what the machine writes for an insult.
KINDS = {"I": "lone", "f": "framed", "C": "framed", "T": "targeted", "n": "negated", "r": "reported"}


class Scorer:
    """The grammar with a lexicon, ready to score texts."""

    def __init__(self, learned: dict[str, float], without: str = ""):
        self.shares = getattr(learned, "shares", PRIOR)
        # a learned stem replaces the general ones that it begins
        general = {s: w for w, stems in ((0.7, INSULTS), (0.45, MILD)) for s in stems if not any(s.startswith(k) for k in learned)}
        self.weights = general | learned
        self.words = {w[:-1]: c for c, words in CLASSES.items() for w in words}
        starts = sorted({s.rstrip("$") for s in (*self.weights, *THREATS)}, key=lambda s: (-len(s), s))
        self.prefilter = r"(?:^|[^\p{L}])(?:" + "|".join(map(re.escape, starts)) + ")"
        exact = {s[:-1]: w for s, w in self.weights.items() if s.endswith("$")}
        open_ended = {s: w for s, w in self.weights.items() if not s.endswith("$")}
        self.exact, self.open_ended = exact, open_ended
        self.lengths = sorted({len(s) for s in open_ended}, reverse=True)
        self.machine = grammar(without)
        self.seen: dict[str, tuple[str, float]] = {}

    def symbol(self, word: str) -> tuple[str, float]:
        if (known := self.seen.get(word)) is None:
            weight = self.exact.get(word) or next((self.open_ended[word[:n]] for n in self.lengths if word[:n] in self.open_ended), 0.0)
            known = ("I", weight) if weight else (self.words.get(word) or ("O" if word[0].isalpha() else "K" if QUOTES & set(word) else "V"), 0.0)
            if len(self.seen) < 500_000:
                self.seen[word] = known
        return known

    def matches(self, text: str) -> Iterator[tuple[str, float]]:
        """Pattern and weight of each insult in the clauses of a lower-case text, and ("threat", log weight) of threats."""
        for clause in CLAUSE.findall(text):
            read = [self.symbol(w) for w in WORD.findall(clause)]
            if not any(s in "IH" for s, _ in read):
                continue
            read.append(("$", 0.0))
            written, threat = self.machine.run(s for s, _ in read)
            found: list[list] = []
            for (_, weight), out in zip(read, written, strict=True):
                if out in "QC" and found[-1][0] == "lone":  # it completes the frame of the insult before it
                    found[-1][0] = "framed"
                if kind := KINDS.get(out):
                    found.append([kind, weight])
            yield from map(tuple, found)
            if threat:
                yield "threat", threat

    def score(self, text: str) -> tuple[float, int, int]:
        """Score, number of matches and of composed ones (framed, targeted, threats) of a lower-case text.

        The score is 1 minus the product over matches of 1 minus weight.
        """
        rest, kinds = 1.0, Counter()
        for kind, weight in self.matches(text):
            kinds[kind] += 1
            rest *= float(np.exp(-weight)) if kind == "threat" else 1 - min(0.999, weight * self.shares[kind])
        return 1 - rest, kinds.total(), kinds["framed"] + kinds["targeted"] + kinds["threat"]

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``score`` gives for texts, null as empty; only texts with a stem are read word by word."""
        out, matches, composed = np.full(len(texts), NONE), np.zeros(len(texts), np.int32), np.zeros(len(texts), np.int32)
        lower = pc.utf8_lower(pc.fill_null(texts, ""))
        for i in pc.indices_nonzero(pc.match_substring_regex(lower, self.prefilter)).to_pylist():
            value, matches[i], composed[i] = self.score(lower[i].as_py())
            out[i] = max(NONE, value)
        return out, matches, composed


def score_toxicity(docs: DataFrame, learned: dict[str, float]) -> DataFrame:
    """doc_id, held_out, score, predicted, n_matches and n_composed of each row of ``docs(doc_id, text)``; no shuffle.

    A null text is an empty one; texts without a match score ``NONE``. Repeated rows give repeated results, other
    columns are ignored. The lexicon is broadcast; each of its stems explains ``LEAST_DOCS`` documents of the sample.
    """
    bound = docs.sparkSession.sparkContext.broadcast(learned)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        PieceCodec.release()
        scorer = Scorer(bound.value)
        for batch in batches:
            scores, matches, composed = scorer.scores(batch.column(2))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(matches), pa.array(composed)],
                ["doc_id", "held_out", "score", "predicted", "n_matches", "n_composed"],
            )

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), text_of().cast("string").alias("text")).mapInArrow(score, SCHEMA)


def drop_toxic(docs: DataFrame, learned: dict[str, float]) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose ``text`` isn't predicted to be toxic."""
    bound, at = docs.sparkSession.sparkContext.broadcast(learned), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        PieceCodec.release()
        scorer = Scorer(bound.value)
        for batch in batches:
            yield batch.filter(pa.array(scorer.scores(batch.column(at))[0] < 0.5))

    return docs.mapInArrow(keep, docs.schema)
