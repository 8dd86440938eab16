"""Missing or wrong language labels: prediction by partial matching with frozen byte-context statistics.

For each language a variable-order context tree over bytes is built from a bounded sample of labelled rows and frozen.
A text's code length under a language is the sum over its bytes of the cost of the longest known context, or of the
escape from it plus the cost in the next shorter one (escape method C). The shortest code names the language; the
confidence is the posterior share of that language under the code lengths.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "fr", "es", "it", "nl", "pt")
#: ISO 639 codes (two letters, three letters in both variants) and English names.
NAMES = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish"),
    "it": ("it", "ita", "italian"),
    "nl": ("nl", "nld", "dut", "dutch"),
    "pt": ("pt", "por", "portuguese"),
}
#: Labelled rows a language that the trees are fitted on, at most.
SAMPLE_ROWS = 250
#: How much a bit counts as evidence for a language where nothing was held out to find it.
SCALE = 0.1
#: Longest context in bytes.
ORDER = 4
#: Links, addresses, handles and tags carry no language, nor do numbers.
NO_WORDS = re.compile(r"https?://\S+|www\.\S+|\S+@\S+|[@#][\w-]+|\S*\d\S*")
INVISIBLE = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
SENTENCE = re.compile(r"(?<=[.!?…»”\"])\s+|\n+")


def named_language(label: Column) -> Column:
    """The language a label names by code (with or without region, any case) or English name; null if none."""
    head = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]{2,3})(?:[-_][a-z0-9-_]+)?$|^([a-z]{4,})$", 1)
    whole = F.lower(F.trim(label))
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        short, long = [x for x in names if len(x) <= 3], [x for x in names if len(x) > 3]
        out = F.when(head.isin(short) | whole.isin(long), code).otherwise(out)
    return out


def fold(text: str) -> str:
    """Lower case without accents: both may be lost in a text, so the trees see only what always remains."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def letters(text: str) -> str:
    return " ".join(WORD.findall(NO_WORDS.sub(" ", text.translate(INVISIBLE))))


class ContextTrees:
    """Frozen statistics of all languages (from folded texts): for each order, sorted n-gram keys with a code length a language."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER) -> None:
        self.langs = sorted(texts)
        self.order = order
        self.scale, self.label_noise, self.held_out = SCALE, 0.0, float("nan")
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for lang in self.langs:
            data = np.frombuffer(("\n" * order + "\n".join(f" {t} " for t in texts[lang])).encode(), dtype=np.uint8).astype(np.int64)
            levels = []
            for n in range(1, order + 2):
                keys = np.zeros(max(0, len(data) - n + 1), np.int64)
                for i in range(n):
                    keys = (keys << 8) | data[i : i + len(keys)]
                levels.append(np.unique(keys, return_counts=True))
            counts.append(levels)
        width = len(self.langs)
        self.keys: list[np.ndarray] = []
        self.cost: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.escape: list[np.ndarray] = []
        for n in range(1, order + 2):  # n-gram = context of n - 1 bytes and a symbol
            keys = np.unique(np.concatenate([counts[j][n - 1][0] for j in range(width)]))
            heads = np.unique(keys >> 8) if n > 1 else np.zeros(1, np.int64)
            seen = np.zeros((len(keys), width))
            for j in range(width):
                k, c = counts[j][n - 1]
                seen[np.searchsorted(keys, k), j] = c
            at = np.searchsorted(heads, keys >> 8) if n > 1 else np.zeros(len(keys), int)
            total, kinds = np.zeros((len(heads), width)), np.zeros((len(heads), width))
            np.add.at(total, at, seen)
            np.add.at(kinds, at, seen > 0)
            escape = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)), 0.0)
            shorter = self._cost(n - 1, keys & ((1 << (8 * (n - 1))) - 1)) if n > 1 else np.full((len(keys), width), 8.0)
            with np.errstate(divide="ignore"):
                direct = -np.log2(seen / np.maximum(total[at] + kinds[at], 1))
            self.keys.append(keys)
            self.cost.append(np.where(seen > 0, direct, escape[at] + shorter).astype(np.float32))
            if n > 1:
                self.contexts.append(heads)
            self.escape.append(escape.astype(np.float32))

    def _cost(self, n: int, grams: np.ndarray) -> np.ndarray:
        """Code lengths of the last byte of each `n`-gram, a column a language."""
        if n == 0:
            return np.full((len(grams), len(self.langs)), 8.0, np.float32)
        keys = self.keys[n - 1]
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        known = keys[at] == grams
        out = self.cost[n - 1][at].astype(np.float32)
        if not known.all():
            rest = ~known
            lost = grams[rest]
            heads = self.contexts[n - 1]
            where = np.minimum(np.searchsorted(heads, lost >> 8), len(heads) - 1)
            escape = np.where((heads[where] == lost >> 8)[:, None], self.escape[n - 1][where], 0.0)
            out[rest] = escape + self._cost(n - 1, lost & ((1 << (8 * (n - 1))) - 1))
        return out

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Code length in bits of each text (letters only, folded) under each language."""
        data = [(b"\n" * self.order + f" {t} ".encode()) for t in texts]
        sizes = np.array([len(x) for x in data])
        flat = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.int64)
        n = self.order + 1
        keys = np.zeros(max(0, len(flat) - n + 1), np.int64)
        for i in range(n):
            keys = (keys << 8) | flat[i : i + len(keys)]
        unique, back = np.unique(keys, return_inverse=True)
        cost = self._cost(n, unique)[back]
        sums = np.concatenate([np.zeros((1, cost.shape[1])), np.cumsum(cost, axis=0, dtype=np.float64)])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        return sums[np.minimum(ends - self.order, len(sums) - 1)] - sums[starts]


def fit(docs: DataFrame, doc_key: str = "doc_id", text: str = "text", label: str = "lang", sample_rows: int = SAMPLE_ROWS, order: int = ORDER) -> ContextTrees:
    """Trees from at most `sample_rows` rows a named language (smallest hash of the key); labels are corrected in rounds.

    Wrong labels and foreign sentences in the sample are corrected by `purified`.
    """
    named = docs.select(F.col(doc_key).alias("k"), named_language(F.col(label)).alias("named")).where("named is not null and k is not null")
    picked = named.withColumn("r", F.row_number().over(Window.partitionBy("named").orderBy(F.xxhash64("k"), "k"))).where(F.col("r") <= sample_rows).select("k", "named")
    rows = docs.withColumnRenamed(doc_key, "k").select("k", F.col(text).alias("t")).join(F.broadcast(picked), "k").orderBy("k").select("named", "t").collect()  # at most sample_rows a language
    parts = [(r.named, x) for r in rows if r.t for x in SENTENCE.split(r.t) if len(letters(x)) >= 12]
    return purified(parts, order)


def purified(parts: list[tuple[str, str]], order: int = ORDER, folds: int = 3, rounds: int = 3) -> ContextTrees:
    """Trees from labelled sentences whose labels may be wrong, with the scale of their confidences.

    Each round fits trees on all folds but one (a text's sentences are in one fold) and rates the sentences of that one
    by them. The label of a sentence is the language for which its given label, weighed by how often the labels of the
    sample are right, and the evidence speak most; equal sentences have one label, for which all their given labels
    count. Sentences for which two languages come close stay out of the fit. The held-out code lengths
    give `scale`, by which a bit counts as evidence (bytes of a text depend on each other), and `label_noise`, the share
    of the given labels that is explained by chance: both by maximum likelihood of the labels as given. `held_out` is
    the share of held-out sentences rated as their given label says.
    """
    langs = sorted(LANGUAGES)
    if not parts:
        return ContextTrees({lang: [" "] for lang in langs}, order)
    texts = [fold(letters(x)) for _, x in parts]
    given = np.array([langs.index(lang) for lang, _ in parts])
    part = np.arange(len(parts)) * folds // len(parts)  # sentences of a text stand together
    text_of = pd.factorize(pd.Series(texts))[0]
    votes = np.zeros((text_of.max() + 1, len(langs)))
    np.add.at(votes, (text_of, given), 1)

    def build(rows: np.ndarray, label: np.ndarray) -> ContextTrees:
        by: dict[str, list[str]] = {lang: [" "] for lang in langs}
        for at in rows.tolist():
            by[langs[label[at]]].append(texts[at])
        return ContextTrees(by, order)

    label, sure = given.copy(), np.ones(len(texts), bool)
    bits = np.zeros((len(texts), len(langs)))
    for _ in range(rounds):
        for f in range(folds):
            rest, mine = np.nonzero((part != f) & sure)[0], np.nonzero(part == f)[0]
            if len(rest) and len(mine):
                bits[mine] = build(rest, label).lengths([texts[i] for i in mine.tolist()])
        scale, noise = calibrated(bits, given)
        best = bits.argmin(axis=1)
        # How often a text of each language bears each label, by the evidence alone: wrong labels are no even mixture.
        borne = np.ones((len(langs), len(langs)))
        np.add.at(borne, (given, best), 1)
        told = np.log2(borne / borne.sum(axis=1, keepdims=True))
        # Equal sentences have one language: all their labels vote, and their bits count once.
        mean = np.zeros(votes.shape)
        np.add.at(mean, text_of, bits)
        score = votes @ told - scale * mean / votes.sum(axis=1, keepdims=True)
        label = score.argmax(axis=1)[text_of]
        ranked = np.sort(score, axis=1)
        sure = (ranked[:, -1] - ranked[:, -2] > 3)[text_of]  # eight to one
    trees = build(np.nonzero(sure)[0], label)
    trees.scale, trees.label_noise = scale, noise
    trees.held_out = float((bits.argmin(axis=1) == given).mean())
    return trees


def calibrated(bits: np.ndarray, given: np.ndarray) -> tuple[float, float]:
    """(scale, noise) of the model: a label is drawn from 2^(-scale * bits), or with chance `noise` from all languages."""
    best = (-np.inf, SCALE, 0.0)
    less = bits - bits.min(axis=1, keepdims=True)
    at = np.arange(len(bits))
    for scale in (0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5, 0.8):
        share = np.exp2(-scale * less)
        p = share[at, given] / share.sum(axis=1)
        for noise in (0.0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4):
            fit = float(np.log((1 - noise) * p + noise / bits.shape[1] + 1e-12).sum())
            if fit > best[0]:
                best = (fit, scale, noise)
    return best[1], best[2]


def segments(docs: DataFrame, trees: ContextTrees, doc_key: str = "doc_id", text: str = "text", min_words: int = 2) -> DataFrame:
    """`(doc_key, paragraph, segment, start_at, lang, confidence, n_words)`: runs of sentences of one language.

    Each sentence gets the language of its shortest code; a short sentence leans on its paragraph. Neighbouring
    sentences of one language form a segment. `paragraph` and `segment` count from 0, `start_at` is the position of the
    segment's first character. Paragraphs with fewer than `min_words` words outside links, tags and numbers give no row.
    Null keys are dropped, null and empty texts give no rows, repeated rows repeat their rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    schema = f"`{doc_key}` long, paragraph int, segment int, start_at int, lang string, confidence double, n_words int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = sent.value
        names = np.array(trees.langs)
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                yield label(pdf.iloc[lo : lo + 256], trees, names)

    def label(pdf: pd.DataFrame, trees: ContextTrees, names: np.ndarray) -> pd.DataFrame:
        meta, pieces = [], []
        for k, t in zip(pdf.k, pdf.t):
            at = 0
            number = 0
            for gap in [*re.finditer(r"\n[^\S\n]*\n\s*", t), None]:
                end = gap.start() if gap else len(t)
                para = t[at:end]
                cuts = [0, *(m.end() for m in SENTENCE.finditer(para)), len(para)]
                inside = []
                for a, b in zip(cuts, cuts[1:]):
                    bare = letters(para[a:b])
                    if bare:
                        inside.append((k, number, at + a, bare.count(" ") + 1, fold(bare)))
                if sum(x[3] for x in inside) >= min_words:
                    meta += [x[:4] for x in inside]
                    pieces += [x[4] for x in inside]
                number += 1
                at = gap.end() if gap else end
        if not meta:
            return pd.DataFrame([], columns=[doc_key, "paragraph", "segment", "start_at", "lang", "confidence", "n_words"])
        bits = trees.lengths(pieces)
        m = pd.DataFrame(meta, columns=["k", "p", "at", "n"])
        group = (m[["k", "p"]] != m[["k", "p"]].shift()).any(axis=1).cumsum().to_numpy() - 1
        whole = np.zeros((group[-1] + 1, bits.shape[1]))
        np.add.at(whole, group, bits)
        words = np.zeros(group[-1] + 1)
        np.add.at(words, group, m.n.to_numpy())
        # A sentence of few words has little evidence of its own: it takes the paragraph's mean bits for 3 words more.
        blended = bits + 3.0 * (whole / words[:, None])[group]
        best = blended.argmin(axis=1)
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (best[1:] != best[:-1])])
        run_of = fresh.cumsum() - 1
        total = np.zeros((run_of[-1] + 1, bits.shape[1]))
        np.add.at(total, run_of, bits)
        rows = np.arange(len(total))
        share = 1 / np.exp2(np.minimum((total[rows, best[fresh]][:, None] - total) * trees.scale, 60)).sum(axis=1)
        first = np.nonzero(fresh)[0]
        n = np.zeros(run_of[-1] + 1, int)
        np.add.at(n, run_of, m.n.to_numpy())
        head = m.iloc[first]
        opens = np.concatenate([[True], group[first][1:] != group[first][:-1]])
        seg = np.arange(len(first)) - np.maximum.accumulate(np.where(opens, np.arange(len(first)), 0))
        return pd.DataFrame({doc_key: head.k.to_numpy(), "paragraph": head.p.to_numpy(np.int32), "segment": seg.astype(np.int32), "start_at": head["at"].to_numpy(np.int32), "lang": names[best[first]], "confidence": share, "n_words": n.astype(np.int32)})

    lean = docs.select(F.col(doc_key).cast("long").alias("k"), F.col(text).alias("t")).where("k is not null and length(t) > 0")
    return lean.mapInPandas(run, schema)


def paragraph_languages(parts: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """`(doc_key, paragraph, lang, n_words, confidence)`: the language of more than half of a paragraph's words."""
    by = parts.groupBy(doc_key, "paragraph", "lang").agg(F.sum("n_words").alias("n"), F.max("confidence").alias("confidence"))
    total = Window.partitionBy(doc_key, "paragraph")
    return by.withColumn("all", F.sum("n").over(total)).where("2 * n > all").select(doc_key, "paragraph", "lang", F.col("all").alias("n_words"), "confidence")


def document_languages(parts: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """`(doc_key, lang, confidence)`: the language with most words of a document; confidence is weighted by words."""
    by = parts.groupBy(doc_key, "lang").agg(F.sum("n_words").alias("n"), F.sum(F.col("n_words") * F.col("confidence")).alias("c"))
    total = Window.partitionBy(doc_key)
    ranked = by.withColumn("all", F.sum("n").over(total)).withColumn("r", F.row_number().over(total.orderBy(F.desc("n"), "lang")))
    return ranked.where("r = 1").select(doc_key, "lang", (F.col("c") / F.col("all")).alias("confidence"))
