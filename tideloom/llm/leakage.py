"""Evaluation texts leaking into training text: rare n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters dropped before words are cut: soft hyphen, zero-width and joining marks.
INVISIBLE = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
WORD = re.compile(r"[^\W_]+")
#: Items are sent to the tasks in blocks of at most so many words, each block against the whole corpus.
BLOCK_WORDS = 2_000_000
#: Rows of the alignment kept for a document at most, or three times the item's words if that is more.
KEPT_ROWS = 2_000


def words(text: str | None) -> list[str]:
    """Unbroken runs of letters and digits, lower case, after invisible characters are dropped."""
    return WORD.findall(text.translate(INVISIBLE).lower()) if text else []


def align(doc: list[str], item: list[str], match: int = 2, other: int = -1, gap: int = -1) -> tuple[int, float, int]:
    """Smith-Waterman over words: (best score, share of matches on the best path, longest exact run).

    The share is that of the aligned passage: matched words by the path's columns (words and gaps), so words of the item
    outside the passage do not count.
    """
    score, path, longest = passage(doc, item, match, other, gap)
    return score, sum(path) / max(1, len(path)), longest


def passage(doc: list[str], item: list[str], match: int = 2, other: int = -1, gap: int = -1) -> tuple[int, list[bool], int]:
    """The best local alignment: (score, for each column of its path whether words match, longest exact run anywhere)."""
    codes: dict[str, int] = {}
    a = np.array([codes.setdefault(w, len(codes)) for w in item])
    b = np.array([codes.get(w, -1) for w in doc])
    run = np.zeros(len(a) + 1, np.int32)
    row = np.zeros(len(a) + 1, np.int64)
    full = np.zeros(len(a) + 1, np.int64)
    span = len(a) * (1 + match)  # a path with a positive score has fewer words of the document
    rows = [row]
    best = longest = end = column = 0
    place = np.arange(len(a) + 1) * gap
    for k, w in enumerate(b.tolist(), 1):
        same = a == w
        run[1:] = np.where(same, run[:-1] + 1, 0)
        longest = max(longest, int(run.max()))
        full[1:] = np.maximum(row[:-1] + np.where(same, match, other), row[1:] + gap)
        # Gaps along the row: the best of all earlier cells less their distance.
        row = np.maximum(np.maximum.accumulate(full - place) + place, 0)
        if len(b) <= max(span, KEPT_ROWS):
            rows.append(row)
        at = int(row.argmax())
        if row[at] > best:
            best, end, column = int(row[at]), k, at
    if not best:
        return 0, [], longest
    if len(rows) == 1:  # a long document: once more over the words that the path can have
        return best, passage(doc[max(0, end - span) : end], item, match, other, gap)[1], longest
    kept = rows[: end + 1]
    path: list[bool] = []
    up, at = len(kept) - 1, column
    while up > 0 and at > 0 and kept[up][at] > 0:
        now, hit = kept[up][at], b[up - 1] == a[at - 1]
        if now == kept[up - 1][at - 1] + (match if hit else other):
            path.append(bool(hit))
            up, at = up - 1, at - 1
        elif now == kept[up - 1][at] + gap:
            path.append(False)
            up -= 1
        else:
            path.append(False)
            at -= 1
    return best, path[::-1], longest


def dense(hits: list[bool], least: float, share: float) -> bool:
    """Whether some stretch of `hits` has at least `least` hits, and these are at least `share` of it."""
    count = np.concatenate([[0], np.cumsum(np.array(hits, dtype=np.int64))])
    if count[-1] < least:
        return False
    over = count - share * np.arange(len(count))
    begin = np.searchsorted(count, count - least, "right") - 1  # the last start that leaves enough hits
    lowest = np.minimum.accumulate(over)
    return bool(((begin >= 0) & (over >= lowest[begin] - 1e-9)).any())


def _grams(tokens: list[str], n: int) -> list[str]:
    return [" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1)]


def leaked_items(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", exact_words: int = 12, seed_words: int = 5, min_share: float = 0.5, passage_share: float = 0.82, own_share: float = 0.76, own_words: int = 3, own_grams: int = 3) -> DataFrame:
    """`(doc_key, item_key, exact_run, score, share, verbatim)` for every document that holds a passage of an item.

    A pair is reported if the document holds `exact_words` consecutive words of the item (`verbatim`), or an edited
    passage: a local alignment in which matches are at least `passage_share` of the columns (words and gaps), and at
    least twice `exact_words`, or `min_share` of the item's words if that is less. It is looked for with edits so dear
    that text less alike ends the path, as like sentences around it would hide it. `score` is that of the best path with
    cheap edits; `share` is of that path, or for an edited passage of the denser one.

    Text less alike, down to `own_share`, is still reported if it holds `own_grams` different runs of `own_words` words
    that no other item has: common sentences of the items have none, an edited copy keeps some.

    Verbatim seeds: of the n-grams of each window of `exact_words` words the one in fewest documents, counted over the
    whole corpus; a window with an n-gram in no document cannot occur verbatim, so these lose nothing. Edited passages
    are seeded by every n-gram of the item, as the rarest ones may stand in another copy only; a seeded document is
    aligned if some stretch of it has enough words of the item (`dense`), which every edited passage has. An edited
    passage without `seed_words` unedited words in a row is found by its own runs only. Items shorter than `exact_words` can only be
    reported by alignment; those shorter than a seed are seeded by all their words.

    Null or empty texts hold nothing; null keys are dropped; repeated rows give one row; empty tables give an empty
    result; other columns are ignored. The item side is a stated query set, sent in blocks of `BLOCK_WORDS` words.
    """
    if not 0 < passage_share < 1:
        raise ValueError("passage_share must be between 0 and 1")
    if not 0 < own_share <= passage_share:
        raise ValueError("own_share must be between 0 and passage_share")
    if seed_words > exact_words:
        raise ValueError("seed_words must not exceed exact_words")
    spark = docs.sparkSession
    lean = docs.select(F.col(doc_key).cast("long").alias("d"), F.col(doc_text).alias("t")).where("d is not null and length(t) > 0")
    asked = items.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and length(t) > 0")
    schema = f"`{doc_key}` long, `{item_key}` long, exact_run long, score long, share double, verbatim boolean"
    out = None
    block: list[tuple[int, list[str]]] = []
    size = 0

    def search(block: list[tuple[int, list[str]]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = {g for _, w in sent.value for g in _grams(w, min(seed_words, len(w)))}
            sizes = sorted({min(seed_words, len(w)) for _, w in sent.value})
            seen: dict[str, int] = defaultdict(int)
            for pdf in batches:
                for t in pdf.t:
                    w = words(t)
                    for n in sizes:
                        for g in known.intersection(_grams(w, n)):
                            seen[g] += 1
            if seen:
                yield pd.DataFrame({"g": list(seen), "n": list(seen.values())}, columns=["g", "n"])

        held = {r.g: r.n for r in lean.select("t").mapInPandas(count, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()}  # at most one row an item n-gram
        seeds: dict[str, list[int]] = defaultdict(list)
        for at, (_, w) in enumerate(block):
            n = min(seed_words, len(w))
            grams = _grams(w, n)
            if not grams:
                continue
            span = max(1, exact_words - n + 1)
            for start in range(max(1, len(grams) - span + 1)):
                window = grams[start : start + span]
                rarest = min(window, key=lambda g: (held.get(g, 0), g))
                if held.get(rarest, 0) and (not seeds[rarest] or seeds[rarest][-1] != at):
                    seeds[rarest].append(at)
        index = spark.sparkContext.broadcast({g: sorted(set(v)) for g, v in seeds.items() if v})
        every: dict[str, list[int]] = defaultdict(list)
        for at, (_, w) in enumerate(block):
            for g in set(_grams(w, min(seed_words, len(w)))):
                if g in held:
                    every[g].append(at)
        loose = spark.sparkContext.broadcast(dict(every))
        holders: dict[str, int] = {}
        for at, (_, w) in enumerate(block):
            for g in set(_grams(w, own_words)):
                holders[g] = at if holders.get(g, at) == at else -1
        single = spark.sparkContext.broadcast({g: at for g, at in holders.items() if at >= 0})

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            asked, table, parts, owner = sent.value, index.value, loose.value, single.value
            keys, own_keys = parts.keys(), owner.keys()
            sizes = sorted({g.count(" ") + 1 for g in keys})
            strict, milder = (max(1, int(2 * x / (1 - x))) for x in (passage_share, own_share))
            vocabulary = [set(w) for _, w in asked]
            least = [min(2 * exact_words, min_share * len(w)) for _, w in asked]
            for pdf in batches:
                found = []
                for d, t in zip(pdf.d, pdf.t):
                    w = words(t)
                    hit: set[int] = set()
                    near: set[int] = set()
                    for n in sizes:
                        for g in keys & set(_grams(w, n)):
                            hit.update(table.get(g, ()))
                            near.update(parts[g])
                    runs: dict[int, int] = defaultdict(int)
                    for g in own_keys & set(_grams(w, own_words)):
                        runs[owner[g]] += 1
                    kept = {at for at, n in runs.items() if n >= own_grams}
                    seen = {at: [x in vocabulary[at] for x in w] for at in near | kept}
                    near = {at for at in near if dense(seen[at], least[at], passage_share)}
                    kept = {at for at in kept if dense(seen[at], least[at], own_share)}
                    for at in sorted(hit | near | kept):
                        i, item = asked[at]
                        edited = at in near and dense(path := passage(w, item, 2, -strict, -strict)[1], least[at], passage_share)
                        if not edited and at in kept:
                            edited = dense(path := passage(w, item, 2, -milder, -milder)[1], least[at], own_share)
                        if not edited and at not in hit:
                            continue
                        score, share, longest = align(w, item)
                        verbatim = longest >= exact_words
                        if verbatim or edited:
                            found.append((d, i, longest, score, share if verbatim else max(share, sum(path) / len(path)), verbatim))
                yield pd.DataFrame(found, columns=[doc_key, item_key, "exact_run", "score", "share", "verbatim"])

        return lean.mapInPandas(probe, schema)

    for i, t in asked.orderBy("i").toLocalIterator():
        w = words(t)
        if not w:
            continue
        block.append((i, w))
        size += len(w)
        if size >= BLOCK_WORDS:
            out = search(block) if out is None else out.union(search(block))
            block, size = [], 0
    if block:
        out = search(block) if out is None else out.union(search(block))
    if out is None:
        return spark.createDataFrame([], schema)
    best = out.groupBy(doc_key, item_key).agg(F.max(F.struct("exact_run", "score", "share", "verbatim")).alias("b"))
    return best.select(doc_key, item_key, "b.exact_run", "b.score", "b.share", "b.verbatim")
