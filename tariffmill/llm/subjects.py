"""Subject areas of documents (problem 10) by weak supervision.

Labelling functions vote on every sentence or abstain:

    seeds     a short lexicon per subject, with the words of the subject's definition
    lexicon   a lexicon learnt from all sentences: word likelihoods per subject by EM, started from the seeds
    section   the heading that the sentence stands under
    address   web and mail addresses in the sentence
    source    the subject that the document's source holds far more of than others
    context   the votes of the sentences before and after it

A latent model learns each function's accuracy (its chance of each vote given the true subject) by EM over the counts of
vote patterns; labels by annotators are no ground truth but one more hint, in the start of the word model, from a bounded
sample of labelled documents (LABELS). Sentences get the subject of the highest posterior, 'none' being one, and a
document the subjects of a third of its sentences or more. Headings and page furniture do not count: lines without closing
punctuation, and lines that over the corpus stand nearly always alone as first or last line.

Texts are split once. Words that stand in a least share of the sentences get a number, sentences become arrays of numbers, and
every later pass is arithmetic on these arrays. What is collected is bounded: words by their least share of sentences,
furniture lines by theirs, sources by theirs of the documents, vote patterns by PATTERNS (more are counted where they are).
Statistics cover all documents; texts are read whole.

Defined results: null or empty texts, and texts of furniture only, have no subject; repeated labels count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread, stored

# Seed words of each subject, English and Spanish, and of sentences on none of them.
SEEDS = {
    "law": "court judge statute attorney plaintiff counsel tribunal ruling legislature penalty regulator justices juez multa demandante juicio abogado reglamento",
    "billing_codes": "codes modifier modifiers coder grouper crosswalk billed procedure digit código códigos modificador codificadora claves facturada",
    "insurance": "deductible premium network insurer copay enrollee payers coinsurance coverage underwriter póliza prima deducible aseguradora afiliados",
    "pharmacy": "pharmacy pharmacist formulary dose dispensed prescription vial refill compounding drugs farmacia farmacéutica dosis formulario frascos inhalador",
    "medicine": "patient nurse surgeon surgeons biopsy physician diagnosed wound ward anesthesia paciente enfermera cirugía médico herida fiebre",
    "software": "parser server cache module developer library release schema loader servidor analizador biblioteca versión programa cargador",
    "finance": "treasurer budget auditor debt revenue audited bonds endowment fiscal investors ingresos presupuesto tesorería auditor deuda",
    "statistics": "sample median variance regression estimator survey confounder percentile outliers bootstrap muestra varianza mediana sesgo intervalo",
    "none": "page copy links questions thank keep later index refreshed shared replaces away follow changed página copia gracias guarde noticias tarifas renovó después",
}
OPENERS = ("in addition", "even so", "as noted", "by contrast", "in short", "at the same time", "however", "además", "en resumen", "sin embargo")
NONE = "none"
# ------------------------------------------------------------------

#: Least share of sentences a word must stand in to be learnt; most labelled documents used.
LEAST_SHARE, LABELS = 2e-4, 5_000
#: Weight of a sentence's mean word evidence against its document's mixture, per round of EM after the first: low at
#: first, so that a sentence form is not held by the subject that its first seed happened to suggest.
SEED_BONUS = 3.0
ANNEAL = (0.3, 0.3, 0.5, 1.0, 3.0, 10.0)
#: A sentence treats a subject if its posterior is the highest; a document if so do one in THIRD of its sentences.
THIRD = 3
#: Sources that hold less than such a share of the documents have no vote; most vote patterns brought to the driver; most subjects.
SOURCE_SHARE, PATTERNS, MOST_SUBJECTS = 1e-4, 200_000, 1_000
#: Words looked at together in a pass; their arrays fit the processor's cache.
SLICE = 40_000
#: A line is furniture if it stands as first or last line in such a share of the documents and so often of all its places.
EDGE_SHARE, EDGE_ONLY = 1e-3, 0.8

ADDRESS = re.compile(r"(?:https?://|www\.|[\w.-]+@)\S+")
END = re.compile(r"[.?!][\"”’)]*\s+(?=\S)")
NUMBER_WORD = re.compile(r"\b[nN]o\.\Z")
WORD = re.compile(r"[^\W\d_]{2,}")
#: Words for voting: short ones are mostly function words and tell the language, not the subject.
LONG = re.compile(r"[^\W\d_]{4,}")
DIGITS = re.compile(r"\d+")
CLOSERS, TERMINAL = '"”’)', (".", "?", "!")


def line_key(line: str) -> str:
    return DIGITS.sub("9", line.strip().lower())


@lru_cache(maxsize=16)
def heads_of(keys: frozenset[str]) -> frozenset[str]:
    return frozenset(k[:3] for k in keys)


def is_among(line: str, keys: frozenset[str], heads: frozenset[str]) -> bool:
    """line_key(line) is one of the keys; lines that start with three other ASCII letters are told without the key."""
    h = line[:3]
    return (h.lower() in heads or not (h.isascii() and h.isalpha())) and line_key(line) in keys


def lines_of(text: str) -> list[str]:
    return [x for x in map(str.strip, text.splitlines()) if x]


def split_sentences(text: str) -> list[str]:
    """Cut behind closing punctuation, not behind 'no.' as in 'No. 5'."""
    out, at = [], 0
    for m in END.finditer(text):
        stop = m.start() + 1
        if text[stop - 2 : stop] in ("o.",) and NUMBER_WORD.search(text, max(at, stop - 4), stop):
            continue
        out.append(text[at:stop])
        at = m.end()
    out.append(text[at:])
    return out


def sentences(text: str, furniture: frozenset[str] = frozenset()) -> tuple[list[str], str]:
    """(sentences, heading): lines of furniture and lines without closing punctuation are left out; the first of them is the heading."""
    out, heading, held, heads = [], "", "", heads_of(furniture)
    for line in lines_of(text):
        if furniture and is_among(line, furniture, heads):
            heading = heading or line
            continue
        if not line.rstrip(CLOSERS).endswith(TERMINAL):
            if not held and len(WORD.findall(line)) < 8:
                heading = heading or line
                continue
            held += " " + line  # a sentence broken over lines
            continue
        out += [s for s in split_sentences((held + " " + line).strip() if held else line) if WORD.search(s)]
        held = ""
    if held:
        out += [s for s in split_sentences(held.strip()) if len(WORD.findall(s)) >= 8]
    return out, heading


@lru_cache(maxsize=200_000)
def words(sentence: str) -> tuple[str, ...]:
    s = sentence.lower()
    if s.startswith(OPENERS):
        s = s[len(next(o for o in OPENERS if s.startswith(o))) :]
    return tuple(dict.fromkeys(LONG.findall(s)))


class Model:
    """Log shares of the subjects and log likelihoods per word number (zeros for words that say nothing)."""

    def __init__(self, counts: np.ndarray, totals: np.ndarray, least: float) -> None:
        n = totals + 1.0
        self.prior = np.log(n / n.sum())
        w = np.log((counts + 0.1) / (n + 2.0))
        # what a word unknown to a subject says is kept from deciding alone
        w = np.maximum(w, w.max(axis=1, keepdims=True) - 6.0)
        self.rows = np.where(counts.sum(axis=1, keepdims=True) >= least, w, 0.0)


def seed_table(definitions: dict[str, str]) -> tuple[list[str], dict[str, set[int]]]:
    subjects = [*sorted(definitions), NONE]
    own: dict[str, set[int]] = {}
    for k, s in enumerate(subjects):
        for w in {*SEEDS.get(s, "").split(), *(w for w in WORD.findall(definitions.get(s, "").lower()) if len(w) > 4)}:
            own.setdefault(w, set()).add(k)
    return subjects, {w: ks for w, ks in own.items() if len(ks) == 1}


def seed_vote(ws: tuple[str, ...], seeds: dict[str, set[int]], n: int) -> int:
    """The subject with most seed words, -1 without any or in a tie."""
    hits = [k for w in ws for k in seeds.get(w, ())]
    if not hits:
        return -1
    count = [hits.count(k) for k in range(n)]
    best = max(count)
    return count.index(best) if count.count(best) == 1 else -1


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of rows; groups may be empty."""
    total = np.zeros((len(values) + 1, values.shape[1]))
    np.cumsum(values, axis=0, out=total[1:])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def softmax(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


TEXTS = "doc_id long, source string, body string, sizes array<int>, seeds array<int>, linked array<int>, section int"


def prepare(docs: DataFrame, furniture: frozenset[str], seeds: dict[str, set[int]], n: int) -> DataFrame:
    """Documents as words, with the words of each sentence (sizes) and the votes that need the text, written once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        votes: dict[tuple[str, ...], int] = {}

        def vote(ws: tuple[str, ...]) -> int:
            known = votes.get(ws)
            if known is None:
                if len(votes) > 200_000:
                    votes.clear()
                known = votes[ws] = seed_vote(ws, seeds, n)
            return known

        for pdf in batches:
            rows = []
            for doc, text, source in zip(pdf.doc_id, pdf.text, pdf.source):
                body, head = sentences(text, furniture)
                said = [words(s) for s in body]
                links = [seed_vote(tuple(LONG.findall(" ".join(ADDRESS.findall(s)).lower())), seeds, n) if "@" in s or "/" in s or "www" in s else -1 for s in body]
                section = seed_vote(words(head), seeds, n) if head else -1
                rows.append((doc, source, " ".join(w for ws in said for w in ws), [len(ws) for ws in said], [vote(ws) for ws in said], links, section))
            yield pd.DataFrame(rows, columns=["doc_id", "source", "body", "sizes", "seeds", "linked", "section"])

    return stored(docs.mapInPandas(run, TEXTS))


def vocabulary(texts: DataFrame, least: float) -> list[str]:
    """The words that stand in enough sentences (a word counts once in each); at most (words per sentence) / LEAST_SHARE."""
    each = texts.select(F.explode(F.split("body", " ")).alias("w")).filter("w <> ''")
    return sorted(r.w for r in each.groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("w").collect())


NUMBERED = "doc_id long, source string, ids array<int>, known array<int>, sizes array<int>, seeds array<int>, linked array<int>, section int"


def numbered(texts: DataFrame, vocab: list[str]) -> DataFrame:
    """Texts with word numbers in place of words; known: how many words of each sentence have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {w: k for k, w in enumerate(vocab)}
        for b in batches:
            col = {name: b.column(k) for k, name in enumerate(b.schema.names)}
            ids, known = [], []
            for body, sizes in zip(col["body"].to_pylist(), col["sizes"].to_pylist()):
                all_ = np.fromiter(map(at.get, body.split(" ") if body else (), repeat(-1)), dtype=np.int32)
                ids.append(all_[all_ >= 0])
                known.append(sums((all_ >= 0)[:, None].astype(float), np.array(sizes, dtype=np.int64))[:, 0].astype(np.int32))
            made = {"ids": pa.array(ids, type=pa.list_(pa.int32())), "known": pa.array(known, type=pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_arrays([made.get(c, col.get(c)) for c in NAMES], names=NAMES)

    return stored(texts.mapInArrow(run, NUMBERED))


NAMES = [c.split(" ")[0] for c in NUMBERED.split(", ")]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, length per row) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


class Part:
    """Some documents of a batch as arrays over words, sentences and documents."""

    def __init__(self, b: pa.RecordBatch) -> None:
        col = {name: b.column(k) for k, name in enumerate(b.schema.names)}
        self.docs, self.sources = col["doc_id"].to_numpy(zero_copy_only=False), col["source"]
        self.ids, _ = flat(col["ids"])
        self.known, self.per_doc = flat(col["known"])
        self.sizes, self.seeds, self.linked = (flat(col[c])[0] for c in ("sizes", "seeds", "linked"))
        self.section = col["section"].to_numpy(zero_copy_only=False)
        self.doc_of = np.repeat(np.arange(len(self.per_doc)), self.per_doc)

    def said(self, model: Model) -> np.ndarray:
        """Log likelihoods of the sentences."""
        return sums(model.rows[self.ids], self.known)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    """Batches in slices of about SLICE words, so that a pass holds little at a time however long the documents are."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(flat(b.column(b.schema.get_field_index("ids")))[1])
        at = 0
        while at < b.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + SLICE, side="right")))
            yield Part(b.slice(at, to - at))
            at = to


def posteriors(model: Model | None, p: Part, n: int, hints: list[list[int] | None], heat: float) -> np.ndarray:
    """Subject shares of all sentences of a part while learning. The document's own mixture is the prior of its sentences, so that
    a sentence without known words goes where its neighbours are; labels of the document weigh in. Before any model only
    sentences with seed words count."""
    one = np.zeros((len(p.known), n))
    has = p.seeds >= 0
    one[np.flatnonzero(has), p.seeds[has]] = 1.0
    labelled = [d for d, h in enumerate(hints) if h]
    if model is None:
        for d in labelled:
            for i in np.flatnonzero(p.doc_of == d):
                if 0 <= p.seeds[i] < n - 1 and p.seeds[i] not in hints[d]:
                    one[i] *= 0.3
        return one
    logs = p.said(model) * (heat / np.maximum(p.sizes, 1))[:, None] + SEED_BONUS * one
    extra = np.full((len(p.per_doc), n), 0.1)
    for d in labelled:
        extra[d, hints[d]] += 2.0
    mix = np.tile(np.exp(model.prior), (len(p.per_doc), 1))
    for _ in range(2):
        post = softmax(logs + np.log(mix)[p.doc_of])
        mix = sums(post, p.per_doc) + extra
        mix /= mix.sum(axis=1, keepdims=True)
    return post


STAT = "word int, k int, n double"


def learn_words(docs: DataFrame, vocab: list[str], n: int, labels: dict[int, list[int]], least: float) -> Model:
    """EM of word likelihoods over all sentences. Counts are summed per task, then by word; a round passes over numbers only."""
    size = len(vocab)
    model: Model | None = None
    for heat in (0.0, *ANNEAL):
        now = model

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc, everything = np.zeros(size * n), np.zeros(n)
            for p in parts(batches):
                post = posteriors(now, p, n, [labels.get(d) for d in p.docs.tolist()], heat)
                for k, share in enumerate(np.ascontiguousarray(post.T) if size else ()):
                    acc[k * size : (k + 1) * size] += np.bincount(p.ids, weights=np.repeat(share, p.known), minlength=size)
                everything += post.sum(axis=0)
            at = np.flatnonzero(acc > 1e-3)
            word, k, c = np.concatenate([at % max(size, 1), np.full(n, -1)]), np.concatenate([at // max(size, 1), np.arange(n)]), np.concatenate([acc[at], everything])
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(c)], names=["word", "k", "n"])

        counts, totals = np.zeros((size, n)), np.zeros(n)
        for r in docs.mapInArrow(count, STAT).groupBy("word", "k").agg(F.sum("n").alias("n")).collect():  # words of the vocabulary x subjects
            if r.word < 0:
                totals[r.k] = r.n
            else:
                counts[r.word, r.k] = r.n
        model = Model(counts, totals, least)
    assert model is not None
    return model


FUNCTIONS = ("seeds", "lexicon", "section", "address", "context", "source")
#: Place of the lexicon's vote from the end of a code without the source's.
LEXICON_AT = 3


def lexicon_votes(p: Part, model: Model) -> np.ndarray:
    logs = model.prior + p.said(model)
    top = logs.max(axis=1, keepdims=True)
    sure = (top - (top + np.log(np.exp(logs - top).sum(axis=1, keepdims=True))))[:, 0] > np.log(0.6)
    return np.where(sure, logs.argmax(axis=1), -1)


def vote_codes(p: Part, model: Model, n: int) -> np.ndarray:
    """The votes of all functions but the source's on each sentence as one number, in base n + 1. context: the votes of the sentences
    beside it, if they are one."""
    lex = lexicon_votes(p, model)
    starts = np.cumsum(p.per_doc) - p.per_doc
    first, last = np.zeros(len(lex), dtype=bool), np.zeros(len(lex), dtype=bool)
    first[starts[p.per_doc > 0]] = True
    last[(starts + p.per_doc - 1)[p.per_doc > 0]] = True
    left, right = np.roll(lex, 1), np.roll(lex, -1)
    context = np.where(first, np.where(last, -1, right), np.where(last | (left == right), left, -1))
    code = np.zeros(len(lex), dtype=np.int64)
    for v in (p.seeds, lex, p.section[p.doc_of], p.linked, context):
        code = code * (n + 1) + (v + 1)
    return code


def votes_of(codes: np.ndarray, n: int) -> np.ndarray:
    out = np.empty((len(codes), len(FUNCTIONS)), dtype=np.int64)
    rest = codes.copy()
    for j in reversed(range(len(FUNCTIONS))):
        out[:, j] = rest % (n + 1) - 1
        rest //= n + 1
    return out


def posterior_of(votes: np.ndarray, prior: np.ndarray, conf: list[np.ndarray]) -> np.ndarray:
    """Class posteriors of rows of votes; -1 abstains."""
    logp = np.log(prior) + sum(np.log(conf[j][:, votes[:, j]]).T for j in range(votes.shape[1]))
    return np.exp(logp - np.logaddexp.reduce(logp, axis=1)[:, None])


def posterior(vote: tuple[int, ...], prior: np.ndarray, conf: list[np.ndarray]) -> np.ndarray:
    return posterior_of(np.array([vote]), prior, conf)[0]


def expected(votes: np.ndarray, weight: np.ndarray, prior: np.ndarray, conf: list[np.ndarray]) -> np.ndarray:
    """E step: the expected count of (function, class, vote), a vote of -1 in the last place; one row more holds the classes."""
    n = len(prior)
    post = posterior_of(votes, prior, conf) * weight[:, None]
    out = np.zeros((len(conf) + 1, n, n + 1))
    for j in range(len(conf)):
        np.add.at(out[j].T, votes[:, j], post)
    out[-1, :, 0] = post.sum(axis=0)
    return out


def learn_accuracies(patterns: dict[tuple[int, ...], float] | DataFrame, n: int, rounds: int = 30) -> tuple[np.ndarray, list[np.ndarray]]:
    """(class shares, per function the chance of each vote given the class; the last column is abstaining) by EM over patterns, a dict or a
    DataFrame(code, n) of more patterns than the driver should hold, over which each E step is one job."""
    prior = np.full(n, 1.0 / n)
    start = [0.8, 0.95, 0.3, 0.6, 0.4, 0.2]
    conf = []
    for a in start:
        c = np.full((n, n + 1), (1 - a) * 0.5 / max(n - 1, 1))
        c[:, n] = 0.5
        c[np.arange(n), np.arange(n)] = a * 0.5
        conf.append(c / c.sum(axis=1, keepdims=True))
    if isinstance(patterns, dict):
        votes, weight = np.array(list(patterns)), np.array(list(patterns.values()), dtype=float)
    for _ in range(rounds):
        if isinstance(patterns, dict):
            counts = expected(votes, weight, prior, conf)
        else:
            counts = expected_of_table(patterns, prior, conf)
        classes = counts[-1, :, 0]
        prior = (classes + 1.0) / (classes.sum() + n)
        for j in range(len(conf)):
            c = counts[j] + 0.01
            c[np.arange(n), np.arange(n)] += 2.0  # functions are better than chance
            conf[j] = c / c.sum(axis=1, keepdims=True)
    return prior, conf


def expected_of_table(patterns: DataFrame, prior: np.ndarray, conf: list[np.ndarray]) -> np.ndarray:
    n = len(prior)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((len(conf) + 1, n, n + 1))
        for pdf in batches:
            acc += expected(votes_of(pdf.code.to_numpy(), n), pdf.n.to_numpy(dtype=float), prior, conf)
        yield pd.DataFrame({"at": np.arange(acc.size), "v": acc.ravel()})

    out = np.zeros((len(conf) + 1) * n * (n + 1))
    for r in patterns.mapInPandas(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r.v
    return out.reshape(len(conf) + 1, n, n + 1)


def furniture_of(docs: DataFrame, total: int) -> frozenset[str]:
    """Lines that stand alone at the top or foot of documents: first the lines that often are first or last, of which there are at most
    2 / EDGE_SHARE, then all places of these. No other line leaves its task."""

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[str, int] = {}
        held = 0
        for pdf in batches:
            for text in pdf.text:
                lines = lines_of(text)
                for k in dict.fromkeys((0, len(lines) - 1)) if lines else ():
                    key = line_key(lines[k])
                    if key not in acc:
                        held += len(key)
                    acc[key] = acc.get(key, 0) + 1
            if held > 50_000_000:
                yield pd.DataFrame(list(acc.items()), columns=["line", "edge"])
                acc, held = {}, 0
        yield pd.DataFrame(list(acc.items()), columns=["line", "edge"])

    seen = docs.mapInPandas(edges, "line string, edge long").groupBy("line").agg(F.sum("edge").alias("edge"))
    edge = {r.line: r.edge for r in seen.filter(F.col("edge") >= max(3.0, EDGE_SHARE * total)).collect()}
    if not edge:
        return frozenset()
    known = frozenset(edge)
    heads = heads_of(known)

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[str, int] = {}
        for pdf in batches:
            for text in pdf.text:
                for line in lines_of(text):
                    if is_among(line, known, heads):
                        key = line_key(line)
                        acc[key] = acc.get(key, 0) + 1
        yield pd.DataFrame(list(acc.items()), columns=["line", "n"])

    every = docs.mapInPandas(places, "line string, n long").groupBy("line").agg(F.sum("n").alias("n")).collect()
    return frozenset(r.line for r in every if edge[r.line] >= EDGE_ONLY * r.n)


def patterns_by_source(docs: DataFrame, model: Model, n: int, large: list[str]) -> DataFrame:
    """(source, code, n): how often the functions but the source's vote in each way, by source (numbers; -1 for all that are not large)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {s: i for i, s in enumerate(large)}
        acc: dict[tuple[int, int], int] = {}
        for p in parts(batches):
            codes = vote_codes(p, model, n)
            source = np.array([at.get(s, -1) for s in p.sources.to_pylist()], dtype=np.int64)[p.doc_of]
            for s in np.unique(source).tolist():
                for code, c in zip(*(x.tolist() for x in np.unique(codes[source == s], return_counts=True))):
                    acc[s, code] = acc.get((s, code), 0) + c
        cols = [pa.array([s for s, _ in acc], type=pa.int64()), pa.array([c for _, c in acc], type=pa.int64()), pa.array(list(acc.values()), type=pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["source", "code", "n"])

    return docs.mapInArrow(count, "source long, code long, n long").groupBy("source", "code").agg(F.sum("n").alias("n"))


def source_votes(patterns: DataFrame, n: int, large: list[str]) -> dict[int, int]:
    """The subject that a source has at least twice as much of as all sources together, by the lexicon's votes."""
    shares = np.zeros((len(large) + 1, n))
    vote = F.expr(f"cast((code div {(n + 1) ** LEXICON_AT}) % {n + 1} - 1 as int)")
    for r in patterns.groupBy("source", vote.alias("k")).agg(F.sum("n").alias("n")).filter("k >= 0").collect():
        shares[r.source, r.k] = r.n  # source -1 is the last row
    base = shares.sum(axis=0) + 1.0
    base /= base.sum()
    out = {}
    for i, v in enumerate(shares[:-1]):
        lift = (v / max(v.sum(), 1.0)) / base
        k = int(lift[: n - 1].argmax()) if n > 1 else -1
        if k >= 0 and lift[k] >= 2.0:
            out[i] = k
    return out


SHARES = "doc_id long, subject string, share double, sentences int"


def classify(documents: DataFrame, subjects: DataFrame, labels: DataFrame, source: str = "source") -> DataFrame:
    """(doc_id, subject, share, sentences) of the subjects that each document treats. Raises for more than MOST_SUBJECTS subjects."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(source).alias("source")).filter("text is not null")
    docs = spread(docs)
    total = max(docs.count(), 1)
    wanted = subjects.filter("subject is not null").limit(MOST_SUBJECTS + 1).collect()
    if len(wanted) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    names, seeds = seed_table({r.subject: r.definition or "" for r in wanted if r.subject})
    n = len(names)
    at = {s: k for k, s in enumerate(names)}
    sample = labels.filter("subject is not null").select("doc_id", "subject").distinct().orderBy(F.xxhash64("doc_id"), "subject").limit(LABELS)
    hints: dict[int, list[int]] = {}
    for r in sample.collect():
        if r.subject in at:
            hints.setdefault(r.doc_id, []).append(at[r.subject])
    texts = prepare(docs, furniture_of(docs, total), seeds, n)
    least = max(2.0, LEAST_SHARE * total * 10)
    vocab = vocabulary(texts, least)
    docs = numbered(texts, vocab)
    model = learn_words(docs, vocab, n, hints, least)
    # at most 1 / SOURCE_SHARE sources
    counted = docs.filter("source <> ''").groupBy("source").agg(F.count("*").alias("n")).filter(F.col("n") >= SOURCE_SHARE * total)
    large = sorted(r.source for r in counted.select("source").collect())
    by = cut(patterns_by_source(docs, model, n, large))
    votes_by = source_votes(by, n, large)
    by_source = {large[i]: k for i, k in votes_by.items()}
    votes = docs.sparkSession.createDataFrame(list(votes_by.items()), "source long, vote long")
    seen = by.join(F.broadcast(votes), "source", "left").groupBy((F.col("code") * (n + 1) + F.coalesce("vote", F.lit(-1)) + 1).alias("code"))
    seen = cut(seen.agg(F.sum("n").alias("n")))
    few = seen.limit(PATTERNS + 1).collect()
    if len(few) > PATTERNS:
        prior, conf = learn_accuracies(seen, n)
    else:
        votes = votes_of(np.array([r.code for r in few], dtype=np.int64), n)
        prior, conf = learn_accuracies({tuple(v): float(r.n) for v, r in zip(votes.tolist(), few)} or {(-1,) * len(FUNCTIONS): 1.0}, n)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts(batches):
            if not len(p.known):
                continue
            source = np.array([by_source.get(s, -1) for s in p.sources.to_pylist()], dtype=np.int64)
            codes, back = np.unique(vote_codes(p, model, n) * (n + 1) + source[p.doc_of] + 1, return_inverse=True)
            best = posterior_of(votes_of(codes, n), prior, conf).argmax(axis=1)[back]
            got = np.bincount(p.doc_of * n + best, minlength=len(p.per_doc) * n).reshape(-1, n)[:, : n - 1]
            d, k = np.nonzero((got > 0) & (THIRD * got >= p.per_doc[:, None]))
            cols = [pa.array(p.docs[d]), pa.array([names[i] for i in k], type=pa.string()), pa.array(got[d, k] / p.per_doc[d]), pa.array(p.per_doc[d].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "subject", "share", "sentences"])

    return docs.mapInArrow(judge, SHARES)
