"""Operator 9, toxicity by Levenshtein automata over a lexicon trie.

The lexicon is learned: terms (whole words, or stems that many words begin with) that occur in many different contexts
of texts labelled toxic and hardly in others. A text's words run through one automaton, the product of the lexicon's trie
with the Levenshtein automaton of one edit (insertion, deletion, substitution or swap), made deterministic state by
state as words need it. Each hit gets a score from its context window: full for plain use, less inside quotation marks
or beside words that report speech. A logistic regression over sums of these scores, by kind of hit, gives the
probability of label 1.

Learning uses at most about ``TRAIN_ROWS`` labelled rows (chosen by a hash of the id, at random and alike on each run);
the lexicon, which has every term that tells, and the regression are as large as these rows make them. Every text is
scored whole.
"""
from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, small_batches, stored, table, with_columns_of_text

TRAIN_ROWS = 20_000
WINDOW = 6  # words to each side of a hit
MIN_G2 = 28.0  # likelihood ratio that a term needs
MIN_ODDS = 20.0
STEM_LETTERS = (4, 12)
FUZZY_LETTERS = 5  # shorter terms match exactly only
WORD = re.compile(r"[^\W_]+")
#: FIXED values: quotation marks, and words that report another's speech (en, de, fr, es).
QUOTES = "\"“”„«»‹›"
REPORTING = {
    "said", "says", "say", "wrote", "writes", "called", "calls", "quoted", "quote", "quotes", "word", "words", "term",
    "sagte", "sagt", "schrieb", "zitat", "wort", "nannte",
    "dit", "disait", "écrit", "mot", "citation", "appelé",
    "dijo", "dice", "escribió", "palabra", "cita", "llamó",
}
FEATURES = ("word", "misspelt", "stem", "stem_misspelt", "quoted", "density")


class Lexicon:
    """Trie of terms and its product with the Levenshtein automaton of one edit, determinised on demand."""

    ITEMS = 300_000  # items of all states kept, some 100 bytes each; then the automaton starts anew (memory only)

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        """``terms``: (text, whether it is a stem). A stem matches words that begin with it."""
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[bool, int]] = {}
        for text, stem in sorted(terms):
            node = 0
            for c in text:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = len(self.children)
                    self.children.append({})
                    self.children[node][c] = nxt
                node = nxt
            self.ends[node] = (stem, len(text))
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.stem: list[int] = []  # best edits of a stem matched so far in this state, 2: none
        self.final: list[int] = []  # best edits of a whole word that ends here, 2: none
        self.items = 0
        self.start = self._state(self._closure({(0, 0, "")}))

    def _closure(self, states: set) -> frozenset:
        """With the states after leaving out a letter of the term."""
        out = set(states)
        for node, edits, swap in states:
            if edits == 0 and not swap:
                out.update((n, 1, "") for n in self.children[node].values())
        return frozenset(out)

    def _state(self, states: frozenset) -> int:
        known = self.ids.get(states)
        if known is not None:
            return known
        stem = final = 2
        for node, edits, swap in states:
            if not swap and node in self.ends:
                is_stem, letters = self.ends[node]
                if edits and letters < FUZZY_LETTERS + is_stem:
                    continue
                if is_stem:
                    stem = min(stem, edits)
                else:
                    final = min(final, edits)
        k = self.ids[states] = len(self.sets)
        self.sets.append(states)
        self.items += len(states)
        self.next.append({})
        self.stem.append(stem)
        self.final.append(final)
        return k

    def _step(self, state: int, c: str) -> int:
        """The state after reading ``c``; -1: no term can match any more."""
        out = set()
        for node, edits, swap in self.sets[state]:
            if swap:  # the second of two swapped letters
                if c == swap:
                    out.add((node, 1, ""))
                continue
            kids = self.children[node]
            if c in kids:
                out.add((kids[c], edits, ""))
            if edits == 0:
                out.add((node, 1, ""))  # a letter too many
                for a, n in kids.items():
                    out.add((n, 1, ""))  # a wrong letter
                    if a != c and c in self.children[n]:
                        out.add((self.children[n][c], 1, a))
        k = self._state(self._closure(out)) if out else -1
        self.next[state][c] = k
        return k

    def match(self, word: str) -> tuple[int, int]:
        """Edits of the best whole word and of the best stem (2: none)."""
        if self.items > self.ITEMS:
            self._reset()
        state, stem = self.start, 2
        for c in word:
            nxt = self.next[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if state < 0:
                return 2, stem
            if self.stem[state] < stem:
                stem = self.stem[state]
        return self.final[state], stem


class Scorer:
    """Features of texts; remembers words it has seen (a bounded cache)."""

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        self.lexicon, self.known = Lexicon(terms), {}

    def kind(self, word: str) -> int:
        """0: no hit; else 1 + the index among word, misspelt, stem, stem_misspelt."""
        k = self.known.get(word)
        if k is None:
            final, stem = self.lexicon.match(word)
            k = 1 if final == 0 else 3 if stem == 0 else 2 if final == 1 else 4 if stem == 1 else 0
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[word] = k
        return k

    def features(self, text: str) -> np.ndarray:
        """Sums over a text's hits by kind and context, damped by log(1 + x); zeros without hits."""
        out = np.zeros(len(FEATURES))
        lower = text.lower()
        words = WORD.findall(lower)
        if not any(self.kind(w) for w in set(words)):
            return out
        spans = [m.span() for m in WORD.finditer(lower)]
        quotes = np.array([m.start() for m in re.finditer(f"[{QUOTES}]", lower)], dtype=np.int64)
        for i, w in enumerate(words):
            if k := self.kind(w):
                context = self.context(words, spans, quotes, i)
                out[k - 1] += context
                out[4] += 1 - context
        out[5] = 100 * out[:4].sum() / len(words)
        return np.log1p(out)

    @staticmethod
    def context(words: list, spans: list, quotes: np.ndarray, i: int) -> float:
        """1: plain use; 0.25 inside quotation marks within the window; half of it beside a reporting word."""
        lo, hi = spans[max(0, i - WINDOW)][0] - 1, spans[min(len(words) - 1, i + WINDOW)][1] + 1
        a, b = np.searchsorted(quotes, [spans[i][0], spans[i][1]])
        before = a > 0 and quotes[a - 1] >= lo
        after = b < len(quotes) and quotes[b] < hi
        score = 0.25 if before and after else 1.0
        if any(w in REPORTING for w in words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]):
            score /= 2
        return score


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    """Weights (the intercept last) by Newton's method. Counted weights of hits are kept at zero or more, so that a hit
    never speaks for a clean text."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty, free = np.zeros(x.shape[1]), np.full(x.shape[1], ridge), np.ones(x.shape[1], dtype=bool)
    penalty[-1] = 1e-6
    while True:
        w[~free] = 0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (p - y) + penalty * w
            h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
            step = np.zeros_like(w)
            step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
            w -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        bad = free & (w < 0)
        bad[-1] = False
        if not bad.any():
            return w
        free &= ~bad


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, toxic) of labelled documents whose id is not held out; about ``max_rows`` of them, chosen by a hash."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    y = y.groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    share = min(1.0, max_rows / max(1, y.count()))
    y = y.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1_000_000)) < int(share * 1_000_000))
    # at most about max_rows pairs of longs: bounded by the parameter
    return docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("_text")).join(F.broadcast(y), "doc_id").select("_text", "_toxic")


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn_lexicon(train: DataFrame) -> list[tuple[str, bool]]:
    """Terms of toxic texts: whole words of any length, and stems. A word counts once per pair of neighbours in toxic texts,
    so that copies of one text do not make all its words terms, and once per text in the others. Words of any length are
    also compared text by text, or else frequent short words would be terms for their many neighbours."""

    def words(batches):
        for b in batches:
            toxic: set = set()
            texts: dict = {}
            clean: dict = {}
            for text, label in zip(b["_text"], b["_toxic"], strict=True):
                w = WORD.findall(text.lower())
                if label:
                    toxic.update(zip(w, ["", *w[:-1]], [*w[1:], ""], strict=True))
                counts = texts if label else clean
                for x in set(w):
                    counts[x] = counts.get(x, 0) + 1
            rows = [(x, hash_pair(p, q), 0, 0) for x, p, q in toxic] + [(x, 0, n, 0) for x, n in clean.items()] + [(x, 0, 0, n) for x, n in texts.items()]
            yield pd.DataFrame(rows, columns=["word", "ctx", "neg", "texts"])

    w = train.mapInPandas(words, "word string, ctx long, neg long, texts long")
    w = w.groupBy("word", "ctx").agg(F.sum("neg").alias("neg"), F.sum("texts").alias("texts")).groupBy("word").agg(
        F.sum(F.when(F.col("ctx") != 0, 1).otherwise(0)).alias("pos"), F.sum("neg").alias("neg"), F.sum("texts").alias("texts"))
    with small_batches(train.sparkSession):
        w = stored(train.sparkSession, w, "toxic-words")
    base = train.agg(F.sum("_toxic").alias("p"), F.count("*").alias("n")).first()
    if not base["p"] or base["p"] == base["n"]:
        return []
    odds = base["p"] / (base["n"] - base["p"])
    lo, hi = STEM_LETTERS
    share = base["p"] / base["n"]
    p, n = F.col("pos"), F.col("neg")
    g2 = 2 * (p * F.log(p / (p + n) / share) + F.when(n > 0, n * F.log(n / (p + n) / (1 - share))).otherwise(0))

    def telling(terms: DataFrame) -> DataFrame:
        return terms.where((p > 0) & ((p + 0.5) / (n + 0.5) / odds >= MIN_ODDS)).where(g2 >= MIN_G2)

    stems = w.where(F.length("word") >= lo).select(
        F.explode(F.expr(f"transform(sequence({lo}, least(length(word), {hi})), i -> substr(word, 1, i))")).alias("term"), "pos", "neg", (F.length("word") > hi).alias("cut"))
    stems = stems.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max(F.struct("pos", "cut")).alias("top"))
    good = stored(train.sparkSession, telling(stems), "toxic-stems")
    # a stem whose occurrences all go on with the same letter is not the whole term
    longer = good.select(F.expr("substr(term, 1, length(term) - 1)").alias("term"), F.col("pos").alias("_next")).groupBy("term").agg(F.max("_next").alias("_next"))
    closed = good.join(longer, "term", "left").where(F.col("_next").isNull() | (F.col("_next") < 0.98 * p))
    # nor is one a stem that is hardly more than one word, unless it is cut from a longer one
    closed = closed.select("term", "pos", ((F.col("top.pos") < 0.98 * p) | ((F.length("term") == hi) & F.col("top.cut"))).alias("stem"))
    whole = telling(w.withColumnRenamed("word", "term")).where((F.col("texts") + 0.5) / (n + 0.5) / odds >= MIN_ODDS).select("term", "pos", F.lit(False).alias("stem"))
    terms = stored(train.sparkSession, closed.unionByName(whole).groupBy("term", "stem").agg(F.max("pos").alias("pos")), "toxic-terms")
    # a term of up to as many letters that begins with another closed stem adds nothing
    begins = terms.where(F.length("term").between(lo, hi)).select("term", "stem", F.explode(F.expr(f"transform(sequence({lo}, length(term)), i -> substr(term, 1, i))")).alias("_head"))
    begins = begins.where("_head != term or not stem")
    inside = begins.join(terms.where("stem").select(F.col("term").alias("_head")), "_head", "left_semi").select("term", "stem").distinct()
    # bounded like the rows that are learned from: a term has MIN_G2 behind it
    rows = terms.join(inside, ["term", "stem"], "left_anti").select("term", "stem").collect()
    return sorted((r["term"], r["stem"]) for r in rows)


def hash_pair(a: str, b: str) -> int:
    """A non-zero 63-bit hash that is the same in every process."""
    import xxhash

    return (xxhash.xxh64_intdigest(f"{a} {b}") >> 1) or 1


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> dict:
    """The model: lexicon terms, weights and the score of texts without any label to learn from (0)."""
    prepare(docs)
    train = training_rows(docs, labels, max_rows)
    terms = learn_lexicon(train)
    if not terms:
        share = train.agg(F.avg("_toxic")).first()[0]
        return {"terms": [], "weights": None, "base": float(share or 0.0)}

    def rows(batches):
        scorer = Scorer(terms)
        for b in batches:
            x = np.array([scorer.features(t) for t in b["_text"]]).reshape(-1, len(FEATURES))
            yield pd.DataFrame(x, columns=list(FEATURES)).assign(y=b["_toxic"].to_numpy())

    # equal rows are counted together; what reaches the driver is bounded by max_rows rows of a few numbers
    with small_batches(docs.sparkSession):
        got = train.mapInPandas(rows, ", ".join(f"{f} double" for f in FEATURES) + ", y int").groupBy(*FEATURES, "y").count().toPandas()
    x, y = got[list(FEATURES)].to_numpy(), got["y"].to_numpy(dtype=float)
    n = got["count"].to_numpy()
    order = np.lexsort([*x.T, y])
    return {"terms": terms, "weights": fit_logistic(np.repeat(x[order], n[order], axis=0), np.repeat(y[order], n[order])).tolist(), "base": 0.0}


def score_texts(df: DataFrame, model: dict, out: str = "score") -> DataFrame:
    """``df`` with a probability for its column ``text``; null and empty texts have no hits and score like any text
    without. All columns stay; ``out`` replaces a column of that name."""
    prepare(df)
    keep = [c for c in df.columns if c.lower() != out.lower()]

    def make():
        scorer, w = Scorer(model["terms"]), model["weights"]

        def scores(texts: list) -> list:
            if w is None:
                return [[model["base"]] * len(texts)]
            x = np.array([scorer.features(t) for t in texts]).reshape(-1, len(FEATURES))
            return [1 / (1 + np.exp(-np.clip(x @ np.array(w[:-1]) + w[-1], -30, 30)))]

        return scores

    return with_columns_of_text(df, keep, make, f"`{out}` double")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every whole document scored by a model of the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = score_texts(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
