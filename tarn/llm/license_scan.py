"""License scan by ordered signature rules.

Words of the whole table are hashed in vectorised passes, and one automaton finds which keywords of any rule a
text holds; a text that holds all keywords of no rule is done with that.  Otherwise the rules whose keywords
occur are tried on the whole text, in order; a detection that lies inside one of an earlier rule is suppressed.  Rules see a run of white space, with line ends and the marks of
comment lines in it, as one space, so that wrapped texts match; places are those of the text as it is.  Base phrases (mit license, apache license, general public
license) are counted at every place where their words stand consecutively, and their labels stay in any case.

Defined results: null or blank text has no words, no labels and score 0; n_words, places and labels come
from the whole text, however long; rows that repeat are scanned alike; an empty table gives an empty result.
One pass, no shuffle.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import flat
from tarn.llm.license_rules import Rule, build

BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
RULES = build()


#: Line ends with comment marks before and after, and other white space that is not a single space.
FOLD = re.compile(r"(?:(?:[^\S\r\n]++[*#|]++)?[^\S\r\n]*+(?:\r\n?|\n)[^\S\r\n]*+(?:(?:[#*/;%!>|'-]|::)++|(?:rem|dnl)\b)?)++\s*+|\s{2,}+|[^\S ]")


def folded(text: str) -> tuple[str, list[int], list[int]]:
    """Text with every match of FOLD as one space; places of these; and what to add to a place after the first k."""
    parts, places, added, at, size = [], [], [0], 0, 0
    for m in FOLD.finditer(text):
        parts += [text[at : m.start()], " "]
        size += m.start() - at + 1
        at = m.end()
        places.append(size - 1)
        added.append(at - size)
    return "".join([*parts, text[at:]]), places, added


def detections(text: str, rules: list[Rule]) -> list[tuple[int, int, Rule]]:
    """Places (start, end, rule) in text, already lower-cased, that no earlier place contains."""
    line, places, added = folded(text)
    found = [(m.start(), m.end(), rule) for rule in rules for m in rule.pattern.finditer(line)]
    found.sort(key=lambda x: (x[2].rank // 1000, x[0] - x[1], x[2].rank, x[0]))
    kept: list[tuple[int, int, Rule]] = []
    cover: list[tuple[int, int]] = []  # kept places that no other contains: starts and ends both ascend
    for start, end, rule in found:
        at = bisect.bisect_right(cover, start, key=lambda x: x[0])
        if at and cover[at - 1][1] >= end:
            continue
        kept.append((start, end, rule))
        low = bisect.bisect_left(cover, start, key=lambda x: x[0])
        high = low
        while high < len(cover) and cover[high][1] <= end:
            high += 1
        cover[low:high] = [(start, end)]
    return [(a + added[bisect.bisect_left(places, a)], b + added[bisect.bisect_left(places, b)], rule) for a, b, rule in kept]


def automaton(keywords: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for k in keywords:
        out.add_word(k, k)
    out.make_automaton()
    return out


def scan(docs: DataFrame, rules: list[Rule] = RULES, spans: bool = False) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; with spans also the detections.

    spans adds `found`: label and start and end of each kept detection, counted in characters.
    """
    keywords = sorted({k for r in rules for k in r.keywords})
    automata: list[ahocorasick.Automaton] = []  # one per worker, made there
    by_first: dict[str, list[Rule]] = {}
    for r in rules:
        by_first.setdefault(r.keywords[0], []).append(r)
    phrases = [(np.array([flat.hash_of(w) for w in p.split()], np.uint64), label) for p, label in BASE]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not automata:
            automata.append(automaton(keywords))
        for batch in batches:
            for part, data, at in flat.slices(batch):
                w = flat.words(data, at, flat.ALNUM, fold=True)
                n, words = part.num_rows, len(w.hash)
                owner_end = np.repeat(w.first[1:], np.diff(w.first))
                places, kinds = [], []
                for k, (phrase, _) in enumerate(phrases):
                    hit = np.ones(max(0, words - len(phrase) + 1), bool)
                    for j, h in enumerate(phrase):
                        hit &= w.hash[j : j + len(hit)] == h
                    p = np.flatnonzero(hit)
                    p = p[p + len(phrase) <= owner_end[p]]
                    places.append(p)
                    kinds.append(np.full(len(p), k))
                place, kind = np.concatenate(places), np.concatenate(kinds)
                doc = np.searchsorted(w.first, place, "right") - 1
                n_base, first, last = np.bincount(doc, minlength=n), np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
                local = place - w.first[doc]
                np.minimum.at(first, doc, local)
                np.maximum.at(last, doc, local)
                base = [set() for _ in range(n)]
                for d, k in zip(doc.tolist(), kind.tolist(), strict=True):
                    base[d].add(phrases[k][1])
                lower, edges = data.tobytes().lower(), at.tolist()
                labels, score, found = [set(b) for b in base], np.where(n_base > 0, 0.8, 0.0), [[] for _ in range(n)]
                for d in range(n):
                    line = lower[edges[d] : edges[d + 1]].decode()
                    gate = {k for _, k in automata[0].iter(line)}
                    tried = [r for k in gate for r in by_first.get(k, ()) if gate.issuperset(r.keywords)]
                    if not tried:
                        continue
                    for start, end, rule in detections(line, tried):
                        labels[d].add(rule.label)
                        score[d] = max(score[d], rule.confidence)
                        found[d].append({"label": rule.label, "start": start, "end": end})
                none = n_base == 0
                columns = [
                    part.column(0), pa.array(np.diff(w.first), pa.int64()), pa.array(n_base, pa.int64()),
                    pa.array(first, pa.int64(), mask=none), pa.array(last, pa.int64(), mask=none),
                    pa.array([",".join(sorted(b)) for b in base], pa.string()), pa.array([",".join(sorted(x)) for x in labels], pa.string()),
                    pa.array(score, pa.float64()),
                ]
                names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
                if spans:
                    kind_ = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                    columns, names = [*columns, pa.array(found, kind_)], [*names, "found"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    schema += ", found array<struct<label: string, start: long, end: long>>" * spans
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, schema)
