"""Each operator against brute force, on a table with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.llm import dealing, exact_dedup, fingerprints, flat, language_id, license_scan, mixing, packing, quality, sharding, substring_dedup
from tarn.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, tag string, size int, shard string, part string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table():
    rng = random.Random(5)
    vocabulary = ["the", "MIT", "License", "license", "apache", "ünïcode", "日本", "a|b", "x", *(f"w{i}" for i in range(80))]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = [None, "", "  \n\t", "x", "x", "mit license", "12 345", "é", "GNU General Public License v3", "?!", passage, passage + " tail", "head " + passage, passage + "\x0b" + passage]
    texts += [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 90))) for _ in range(60)]
    texts += ["y " * 3000 + "end", "long " + " ".join(f"n{i}" for i in range(9000)), "same  text", "same  text", "same text"]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, None), (9, "x"), (9, "x"), (9, "other text of a repeated id")]
    out = [(i, t, [None, "en", "fr"][k % 3], [None, "b", "a", "ä", "c"][k % 5], "t", k, "s", "p") for k, (i, t) in enumerate(rows)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_flat_words_and_windows():
    texts = ["a b  a\tc", "", None, " É b\x0b", "Zq", "a"]
    data, at = flat.buffers(pa.array(texts))
    w = flat.words(data, at)
    got = [[data[w.start[i] : w.end[i]].tobytes().decode() for i in range(w.first[d], w.first[d + 1])] for d in range(len(texts))]
    assert got == [WORD.findall(t or "") for t in texts]
    assert w.hash[0] == flat.hash_of("a") and w.hash[0] == w.hash[2] != w.hash[1]
    hashes, place = flat.windows(w.hash, w.first, 2)
    assert place.tolist() == [0, 1, 2, 4] and len(set(hashes.tolist())) == 4
    cut = flat.buffers(pa.array(texts).slice(3, 2))
    assert cut[0].tobytes().decode() == " É b\x0bZq" and cut[1].tolist() == [0, 6, 8]


def test_exact(spark, docs, empty):
    by = collections.defaultdict(list)
    for i, t, *_ in table():
        by[t or ""].append(i)
    want = []
    for i, t, *_ in table():
        keep = max((x for x in by[t or ""] if x is not None), default=None)
        want.append((i, keep, len(by[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows(exact_dedup.exact_report(spark, docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)
    kept = exact_dedup.deduplicate(spark, docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(by) and len({t or "" for _, t in got}) == len(by)
    assert exact_dedup.exact_report(spark, empty).count() == 0


def test_exact_index_persists(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, "digests_of_a_test", f"file://{tmp_path}/index", buckets=2)
    one, two = (spark.createDataFrame(x, "doc_id long, text string") for x in ([(1, "a"), (2, "b")], [(7, "b"), (8, "c"), (9, "c")]))
    assert rows(exact_dedup.exact_report(spark, one, index).filter("kept"), "doc_id") == [(1,), (2,)]
    assert rows(exact_dedup.exact_report(spark, two, index), "doc_id", "keep_id", "kept") == [(7, 2, False), (8, 9, False), (9, 9, True)]
    assert index.read().count() == 3
    # a batch sent again finds its own entries
    assert rows(exact_dedup.exact_report(spark, two.repartition(3), index), "doc_id", "keep_id", "kept") == [(7, 2, False), (8, 9, False), (9, 9, True)]
    assert rows(exact_dedup.deduplicate(spark, two, index), "doc_id") == [(9,)] and index.read().count() == 3
    # under another name the same texts are known
    assert exact_dedup.exact_report(spark, two, index, "again").filter("kept").count() == 0
    index.drop()
    # another session: no such table, another number of shuffle partitions
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        later = exact_dedup.DigestIndex(spark, "digests_of_another_test", f"file://{tmp_path}/index", buckets=7)
        assert later.buckets == 2
        three = spark.createDataFrame([(20, "c"), (21, "d")], "doc_id long, text string")
        assert rows(exact_dedup.exact_report(spark, three, later), "doc_id", "keep_id", "kept") == [(20, 9, False), (21, 21, True)]
        groups = spark.createDataFrame([(b"x", 1)], "digest binary, keep_id long")
        plan = groups.repartition(2, "digest").join(later.read().hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
        assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.sql("DROP TABLE IF EXISTS digests_of_another_test")


def test_exact_leaves_no_table(spark, docs):
    before = spark.catalog.listTables()
    exact_dedup.exact_report(spark, docs).count()
    assert spark.catalog.listTables() == before


def test_scratch_is_released(spark, docs):
    from tarn.llm import common

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    exists = lambda path: (at := jvm.org.apache.hadoop.fs.Path(path)).getFileSystem(conf).exists(at)
    with common.released():
        scratch = common.Scratch(spark, "of-a-test")
        assert scratch.keep(docs, "t").count() == docs.count() and exists(scratch.path)
        with common.released():
            inner = common.Scratch(spark, "inner")
            inner.keep(docs, "t")
        assert not exists(inner.path) and exists(scratch.path)
    assert not exists(scratch.path)


def test_hot_keys_and_components(spark):
    from tarn.llm import common, components

    data = spark.createDataFrame([(k % 3 if k < 3000 else k, k) for k in range(4000)], "key int, v int")
    groups = data.groupBy("key").agg(F.count("*").alias("n"))
    got = common.join_hot(data, groups, ["key"], "n", 4000)
    assert rows(got.select("key", "v", "n"), "key", "v", "n") == rows(data.join(groups, "key"), "key", "v", "n")
    size = common.input_bytes(spark.createDataFrame([("abc",), (None,)], "text string"))
    assert size > 0
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = components.components(common.Scratch(spark, "cc-test"), spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == {x: find(x) for x in root}


def test_sharding(spark, docs, empty):
    got = sharding.shard(spark, docs, 8).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in table()), key=repr
    )
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sharding.shard(spark, empty).count() == 0
    # a third of all rows alike
    hot = sharding.shard(spark, spark.createDataFrame([(None, None)] * 2600 + [(i, "x") for i in range(5000)], "doc_id long, text string")).collect()
    by = collections.defaultdict(list)
    for r in hot:
        by[r.shard].append(r.slot)
    assert len(hot) == 7600 and all(sorted(x) == list(range(len(x))) for x in by.values())

    def jump(key, shards):  # one key at a time, as published
        b, j = -1, 0
        while j < shards:
            b, key = j, (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    some = flat.mix64(np.arange(500, dtype=np.uint64))
    assert all(sharding.jump(some, n).tolist() == [jump(k, n) for k in some.tolist()] for n in (1, 8, 9, 1000))
    keys = np.arange(50_000, dtype=np.uint64)
    for n in (1, 2, 7, 100):
        a, b = sharding.jump(flat.mix64(keys), n), sharding.jump(flat.mix64(keys), n + 1)
        assert ((a == b) | (b == n)).all() and abs((b == n).mean() - 1 / (n + 1)) < 0.01


def test_mixing(spark, docs, empty):
    assert rows(mixing.mix(spark, docs), "doc_id", "size") == sorted(((i, len(WORD.findall(t or ""))) for i, t, *_ in table()), key=repr)
    docs = docs.filter("coalesce(length(text), 0) < 2000")  # a source of one long text and little else can't come near
    got = mixing.mix(spark, docs).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.source_size, r.target].append(r)
        assert r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
    assert all(abs(sum(r.taken for r in g) - target) <= 1 for (_, target), g in by.items())
    again = mixing.mix(spark, docs.repartition(5))
    assert rows(again, "doc_id", "crc", "taken") == sorted(((r.doc_id, r.crc, r.taken) for r in got), key=repr)
    assert mixing.mix(spark, empty).count() == 0
    applied = mixing.apply_mix(spark, docs)
    assert applied.columns == docs.columns and sum(len(WORD.findall(r.text or "")) for r in applied.collect()) == sum(r.taken for r in got)


def test_targets_and_fit():
    t = mixing.targets([("a", 100), (None, 100), ("b", 10), ("c", 100)])
    assert sum(t.values()) == Fraction(3, 2) * 310 and t["b"] <= 20 and max(t.values()) <= 200
    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = np.unique(rng.integers(1, 400, 60))
        counts = rng.integers(1, 9, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum()))
        take = mixing.fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and abs(int((take * lengths).sum()) - budget) <= 1
    assert mixing.fit(np.array([4, 6]), np.array([3, 2]), 11).tolist() in ([1, 1], [1, 1])


def test_mixing_comes_as_near_as_any_subset(spark):
    """Sources of short and of very long texts, each against every sum that whole documents can make."""
    rng = random.Random(9)
    data = []
    for source, lengths in (("a", [rng.randrange(1, 60) for _ in range(150)]), ("b", [9000, 7, 7, 12, 5000]), ("c", [40] * 60), (None, [3, 5, 2000])):
        data += [(len(data) + k, " ".join(["w"] * n), source) for k, n in enumerate(lengths)]
    got = mixing.mix(spark, spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    sources = {i: s for i, _, s in data}
    size = collections.Counter()
    for r in got:
        size[sources[r.doc_id]] += r["size"]
    wanted = mixing.targets(list(size.items()))
    for source, whole in size.items():
        rows_ = [r for r in got if sources[r.doc_id] == source]
        budget = int(wanted[source] + Fraction(1, 2))
        times, rest = divmod(budget, whole)
        sums = 1
        for r in rows_:
            sums |= sums << r["size"]
        nearest = min((abs(s - rest) for s in range(whole + 1) if sums >> s & 1), default=0) if times < 2 else 0
        assert rows_[0].source_size == whole and rows_[0].target == float(wanted[source])
        assert abs(sum(r.taken for r in rows_) - budget) == nearest


def brute_removed(texts, n):
    words = [WORD.findall(t or "") for t in texts]
    count = collections.Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window,period", [(35, 21), (5, 3)])
def test_substring(spark, docs, empty, window, period):
    got = rows(substring_dedup.remove_repeats(spark, docs, window, period), "doc_id", "n_words", "n_removed", "kept_sha256")
    want = sorted(((i, *x) for (i, *_), x in zip(table(), brute_removed([r[1] for r in table()], window), strict=True)), key=repr)
    assert got == want
    assert substring_dedup.remove_repeats(spark, empty, window, period).count() == 0


def test_difference_cover():
    for period in (1, 3, 7, 13, 21):
        cover = np.flatnonzero(substring_dedup.difference_cover(period))
        assert {(int(a) - int(b)) % period for a in cover for b in cover} == set(range(period))


def test_license(spark, docs, empty):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = []
    for i, t, *_ in table():
        w, places, labels = word.findall((t or "").translate(fold)), [], set()
        for phrase, label in license_scan.BASE:
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        want.append((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    got = license_scan.scan(docs)
    assert rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in got.collect())
    assert license_scan.scan(empty).count() == 0


def test_license_rules_and_suppression():
    def labels(text):
        return [(r.label, text[a:b]) for a, b, r in license_scan.detections(text, license_scan.RULES)]

    assert len(license_scan.RULES) > 300 and len({r.pattern.pattern for r in license_scan.RULES}) == len(license_scan.RULES)
    assert labels("licensed under the apache license, version 2.0.")[0][0] == "apache"
    assert {x for x, _ in labels("spdx-license-identifier: bsd-3-clause")} == {"bsd"}
    nested = "you can redistribute it and/or modify it under the terms of the gnu general public license"
    assert [x for x, _ in labels(nested)] == ["gpl"]
    assert labels("nothing to see") == []
    # what the licences say in other places than their first sentence
    for text, label in (("the origin of this software must not be misrepresented; you must not", "zlib"), ("redistributions of source code must retain the above copyright notice, this list of conditions", "bsd"), ("gnu lesser general public license", "lgpl"), ("creative commons attribution-sharealike 4.0 international license", "cc-by-sa")):
        assert labels(text)[0][0] == label and {x for x, _ in labels(text)} == {label}


def test_license_suppression_is_that_of_all_pairs():
    rng = random.Random(4)
    made = [t for _, t in generated()]
    for _ in range(150):
        text = " ".join(rng.choices(made, k=3))
        line, places, added = license_scan.folded(text)
        found = [(m.start(), m.end(), rule) for rule in license_scan.RULES for m in rule.pattern.finditer(line)]
        order = lambda x: (x[2].rank // 1000, x[0] - x[1], x[2].rank, x[0])
        kept = []
        for x in sorted(found, key=order):
            if not any(y[0] <= x[0] and x[1] <= y[1] for y in kept):
                kept.append(x)
        assert [(line[a:b], r) for a, b, r in kept] == [(license_scan.folded(text[a:b])[0], r) for a, b, r in license_scan.detections(text, license_scan.RULES)]


def matches(pattern, rng):
    """A text that the parsed pattern matches, alternatives and repeats drawn at random."""
    out = ""
    for op, arg in pattern:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            kind, value = rng.choice(arg)
            out += "s" if str(kind) == "NEGATE" or str(kind) == "CATEGORY" and "WORD" in str(value) else "3" if str(kind) == "CATEGORY" else chr(value[0] if str(kind) == "RANGE" else value)
            if str(arg[0][0]) == "NEGATE":
                out = out[:-1] + "s"
        elif name == "NOT_LITERAL":
            out += "s"
        elif name == "BRANCH":
            out += matches(rng.choice(arg[1]), rng)
        elif name == "SUBPATTERN":
            out += matches(arg[-1], rng)
        elif name == "MAX_REPEAT":
            out += "".join(matches(arg[2], rng) for _ in range(rng.randint(arg[0], min(int(arg[1]), arg[0] + 2))))
        else:
            assert name in ("AT", "ASSERT_NOT"), name
    return out


def generated():
    rng = random.Random(8)
    return [(rule, matches(re._parser.parse(rule.pattern.pattern), rng)) for rule in license_scan.RULES for _ in range(8)]


def test_license_gate_loses_nothing(spark):
    texts = ["licensed under the GPLv3", "licensed under LGPLv3", "under the terms of the AGPLv3", "License: GPLv2", "License: MPLv2", "Creative Commons Attribution Share Alike license", "limited", ""]
    made = generated()
    assert sum(bool(rule.pattern.search(t)) for rule, t in made) > 0.95 * len(made)
    assert all(k in t for rule, t in made for k in rule.keywords if rule.pattern.search(t))
    texts += [t.upper() for _, t in made]
    rows_ = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(f.label, f.start, f.end) for f in r.found] for r in license_scan.scan(rows_, spans=True).collect()}
    want = {i: [(r.label, a, b) for a, b, r in license_scan.detections(t.lower(), license_scan.RULES)] for i, t in enumerate(texts)}
    assert got == want
    assert [got[i][0][0] for i in range(6)] == ["gpl", "lgpl", "agpl", "gpl", "mpl", "cc-by-sa"]


def test_license_wrapped(spark):
    plain = [(rule, t) for rule, t in generated() if " " in t and "\n" not in t and "  " not in t and " -" not in t and rule.pattern.fullmatch(t)]
    assert {r.pattern.pattern for r, _ in plain} >= {r.pattern.pattern for r in license_scan.RULES if r.rank < 1000 and " -" not in r.pattern.pattern}
    for rule, t in plain:
        for mark in ("\n", "\r\n", "\n * ", "\n# ", "\n    // ", "  ", " *\n * ", "\n#\n# ", "\n;; ", "\t"):
            line = f"x {t} y"
            wrapped = line.replace(" ", mark)
            found = [wrapped[a:b].replace(mark, " ") for a, b, _ in license_scan.detections(wrapped, [rule])]
            assert found and found == [m.group() for m in rule.pattern.finditer(line)], (rule, wrapped)
    header = """/*\n * This is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License"""
    texts = [header, "Redistribution and use in source and binary forms, with or without\nmodification, are permitted", "Permission to use, copy, modify, and/or distribute this software for any\npurpose", "# Altered source versions must be plainly marked as such, and must not be\n# misrepresented", "limited  to\nnothing"]
    rows_ = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(rows_, spans=True).collect()}
    assert [got[i].labels for i in range(5)] == ["gpl", "bsd", "isc", "zlib", ""]
    assert texts[0][got[0].found[0].start : got[0].found[0].end] == header[header.index("you can") :]
    blank = " " * 200_000 + "x" + "\n" * 200_000 + " \n#" * 50_000
    assert license_scan.folded(blank)[0] == " x "


def test_language(spark, empty):
    rng, kinds = random.Random(2), {"aa": "abcde ", "bb": "vwxyz ", "cc": "lmnopé "}
    data = [(i, "".join(rng.choices(kinds[k], k=200)), k) for i, k in enumerate(rng.choices(list(kinds), k=400))]
    data += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 ?!", "bb"), (None, "abcab deabc", None), (1003, "Z", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language_id.fit(spark, docs)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert [got[i].lang_pred for i in (1000, 1001, 1002, None)] == ["und", "und", "und", "aa"] and not got[None].held_out
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in data if i is not None)
    held = [(got[i].lang_pred, k) for i, t, k in data if i is not None and i < 400 and got[i].held_out]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1003].lang_pred in kinds
    assert sum(got[i].rejected for i in range(400)) <= 0.03 * 400
    # n-grams, weights and cosines again, one text and one n-gram at a time
    for i, text, _ in data[:25]:
        chars, vector = "".join(c.lower() if c.isascii() and c.isalpha() else c if ord(c) > 127 else " " for c in text).encode(), collections.Counter()
        for size in (1, 2, 3):
            for k in range(len(chars) - size + 1):
                gram = chars[k : k + size]
                if b"  " not in gram and gram != b" ":
                    vector[((int.from_bytes(gram, "big") + size * 0x1000193) % 2**32 * 0x9E3779B1 % 2**32) >> 20] += 1
        dense = np.zeros(language_id.DIMENSIONS)
        for slot, n in vector.items():
            dense[slot] = np.log1p(n) * model.idf[slot]
        near = [float(c @ dense) / np.sqrt(dense @ dense) for c in model.centroids.astype(float)]
        assert got[i].lang_pred == model.language[int(np.argmax(near))] and abs(got[i].score - max(near)) < 1e-4
    # a third of all rows under one id, and far more rows than the sample takes
    many = spark.createDataFrame([(i, kinds[k] * 5 + str(i), k) for i, k in enumerate(rng.choices(list(kinds), k=6000))] + [(12, "abcd", "aa")] * 3000, "doc_id long, text string, lang string")
    hot = language_id.fit(spark, many, 300)
    assert hot is not None and set(hot.language) == set(kinds) and len(hot.language) <= 12
    assert language_id.predict(docs, language_id.fit(spark, empty)).filter("lang_pred = 'und'").count() == len(data)


def test_fingerprints(spark, docs, empty):
    data = sorted(table(), key=lambda r: (r[0] is None, r[0] or 0))
    got = collections.defaultdict(list)
    for r in fingerprints.fingerprints(spark, docs).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(data)
    single = [k for k, n in collections.Counter(r[0] for r in data).items() if n == 1]
    for k, (i, t, *_) in enumerate(data):
        nxt = data[(k + 1) % len(data)]
        if i in single and nxt[0] in single:
            a, b = t or "", nxt[1] or ""
            edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
            r = got[i][0]
            assert (r.n_chars, r.edited_sha256) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
            for value, x in ((r.near_edited, edited), (r.near_next, b)):
                ca, cx = collections.Counter(WORD.findall(a)), collections.Counter(WORD.findall(x))
                true = sum((ca & cx).values()) / sum((ca | cx).values()) if ca or cx else 1.0
                assert abs(value - true) < 0.25
    by = collections.defaultdict(set)
    for i, t, *_ in data:
        if i in single:
            by[t or ""].add(got[i][0].fingerprint)
    assert all(len(x) == 1 for x in by.values())
    assert fingerprints.fingerprints(spark, empty).count() == 0
    alone = spark.createDataFrame([(4, "a b c d")], "doc_id long, text string")
    assert fingerprints.fingerprints(spark, alone).first().near_next == 1.0


def test_fingerprints_of_all_neighbours(spark):
    """Ids of any size, repeated ones, and many rows without an id, over several ranges."""
    rng = random.Random(6)
    ids = [*range(150), *[2**62 + i for i in range(20)], *[-5] * 30, *[None] * 150]
    data = [(i, " ".join(rng.choices("abcdefgh", k=rng.randrange(0, 12))) if rng.random() < 0.9 else None) for i in ids]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    text = F.coalesce("text", F.lit(""))
    line = docs.select("doc_id", text.alias("t")).orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("t")).collect()
    want = []
    for k, r in enumerate(line):
        a, b = r.t, line[(k + 1) % len(line)].t
        want.append((r.doc_id, hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest()))
    assert rows(fingerprints.fingerprints(spark, docs), "doc_id", "edited_sha256") == sorted(want, key=repr)


def test_tokens_are_those_of_the_whole_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    parts = ["a", "B c", " ", "  ", "\n", "\n\n", "\t", " ", " ", "　", "\x1c", "\u0085", "é", "日本", "🙂", "it's", "12", "...", "!", "​", "﻿", "word", "<|endoftext|>", "<|", "-", "(x", "'s", "'", "…", "×", "ß", "Ωx", "don't", ",", ".\n", "\r\n", "\x00", "\x7f"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 25))) for _ in range(1500)] + [t or "" for _, t, *_ in table()]
    data, at = flat.buffers(pa.array(texts))
    ids, edge = Encoder.of("byte_bpe_50k.json").encode(data, at)
    assert [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_packing(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(spark, docs, ids_out=True).collect()
    by, lines = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        by[r.doc_id, r.doc_tokens].append(r)
        lines[r.sequence_id].append(r)
    texts = collections.defaultdict(list)
    for i, t, *_ in table():
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        texts[i, len(ids)].append(ids)
    assert set(by) == set(texts)
    for key, pieces in by.items():
        assert sum(r.length for r in pieces) == sum(map(len, texts[key]))
        if len(texts[key]) == 1:
            assert [x for r in sorted(pieces, key=lambda r: r.start) for x in r.ids] == texts[key][0]
    for line in lines.values():
        line.sort(key=lambda r: r.offset)
        total = sum(r.length for r in line)
        assert [r.offset for r in line] == [sum(x.length for x in line[:k]) for k in range(len(line))]
        assert total == 2048 or total & (total - 1) == 0
    assert packing.pack_documents(spark, empty).count() == 0


def test_neighbours_share_windows():
    rng = np.random.default_rng(0)
    topics = [rng.integers(0, 2**62, 40).astype(np.uint64) for _ in range(6)]
    words = [rng.choice(topics[k % 6], 50) for k in range(60)]
    pieces = packing.pack(np.full(60, 100), np.arange(60), packing.Index(words), window=1000)
    by = collections.defaultdict(list)
    for d, start, length, sequence, _ in pieces:
        if start == 0:
            by[sequence].append(d % 6)
    assert np.mean([len(set(x)) == 1 for x in by.values()]) > 0.8


def test_neighbours_score_all_words():
    rng = np.random.default_rng(3)
    words = [np.unique(rng.zipf(1.3, 120) % 4000).astype(np.uint64) for _ in range(50)]
    words += [np.concatenate([w, np.arange(10**6 + 40 * k, 10**6 + 40 * k + 14, dtype=np.uint64)]) for k, w in enumerate(words[:5])]
    words += [np.zeros(0, np.uint64), np.array([7, 7, 7], np.uint64)]
    index, n = packing.Index(words), len(words)
    mean = np.mean([len(w) for w in words])
    df = collections.Counter(t for w in words for t in set(w.tolist()))
    for d in range(n):
        score = np.zeros(n)
        for e in range(n):
            for t in set(words[d].tolist()):
                tf = int((words[e] == t).sum())
                if tf and df[t] > 1:
                    score[e] += np.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words[e]) / mean))
        unused = np.arange(n) != d
        got = list(index.neighbours(d, unused))
        assert sorted(got) == np.flatnonzero((score > 0) & unused).tolist()
        assert all(score[a] >= score[b] - 1e-4 for a, b in zip(got[:-1], got[1:], strict=True))


def test_related_documents_are_dealt_together(spark):
    rng = random.Random(4)
    topics = [[f"t{k}x{i}" for i in range(60)] for k in range(8)]
    common = [f"c{i}" for i in range(50)]
    data = [(i, " ".join(rng.choices(topics[i % 8], k=25) + rng.choices(common, k=25))) for i in range(1600)]
    data += [(2000 + i, "one text that many rows hold " + "and again " * 20) for i in range(800)] + [(3000, None), (3001, ""), (None, "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("tag", F.xxhash64("text"))
    tag = F.xxhash64("doc_id", "tag")
    got = [(r.doc_id, r.text, r.shard) for r in dealing.deal(docs, 24, tag).collect()]
    assert sorted((x[:2] for x in got), key=repr) == sorted(data, key=repr)
    size, of = collections.Counter(s for *_, s in got), {i: s for i, _, s in got}
    assert set(size) <= set(range(24)) and max(size.values()) < 4 * len(data) / 24
    copies = collections.Counter(of[2000 + i] for i in range(800))
    assert max(copies.values()) < 400 and len(copies) <= 14
    together = np.mean([of[i] == of[j] for i in range(0, 400) for j in range(i + 8, 400, 8)])
    apart = np.mean([of[i] == of[j] for i in range(0, 400) for j in range(i + 1, 400, 8)])
    assert together > 0.25 and apart < 0.03  # by hash: 1 / 24 of either
    again = {r.doc_id: r.shard for r in dealing.deal(docs.repartition(7), 24, tag).collect()}
    assert again == of
    # more shards than regions, and a third of all rows alike
    old, dealing.REGIONS = dealing.REGIONS, 6
    try:
        more = spark.createDataFrame([*data, *[(None, None)] * 1200], "doc_id long, text string").withColumn("tag", F.xxhash64("text"))
        got = dealing.deal(more, 24, tag).collect()
        size = collections.Counter(r.shard for r in got)
        assert len(got) == len(data) + 1200 and set(size) <= set(range(24)) and max(size.values()) < 1100 and len(size) > 16
        null = collections.Counter(r.shard for r in got if r.doc_id is None and r.text is None)
        assert len(null) > 16 and max(null.values()) < 200
    finally:
        dealing.REGIONS = old
    repeats = dealing.Repeats(3)
    (a, ha), (b, hb) = repeats.find(np.array([5, 5, 7, 5])), repeats.find(np.array([7, 5, 9]))
    assert a.tolist() == [True, True, False, True] and b.tolist() == [True, True, False]
    assert len({*ha.tolist(), *hb.tolist(), *dealing.Repeats(4).find(np.array([5]))[1].tolist()}) == 8
    data_, at = flat.buffers(pa.array([t for _, t in data[:300]] + [None, "", data[0][1]]))
    basis = np.random.default_rng(1).standard_normal((dealing.FEATURES, 5)).astype(np.float32)
    tags = np.arange(len(at) - 1)
    whole = dealing.points(data_, at, tags, basis)
    old, dealing.CHUNK = dealing.CHUNK, 37
    assert np.allclose(whole, dealing.points(data_, at, tags, basis), atol=1e-4)
    dealing.CHUNK = old


def test_expectation_maximisation_by_rows():
    rng = random.Random(3)
    v = np.array([[rng.choice([0, 0, 1, 1, 1, 2]) for _ in range(4)] for _ in range(120)])
    kinds, n = np.unique(v, axis=0, return_counts=True)
    got = quality.expectation_maximisation(kinds, n.astype(float), rounds=7)
    prior, says = 0.5, [[0.03] * 4, [0.4] * 4]
    for _ in range(7):
        p = []
        for row in v:
            like = [1 - prior, prior]
            for k in (0, 1):
                for lab, vote in enumerate(row):
                    like[k] *= {0: 1, 1: 1 - says[k][lab], 2: says[k][lab]}[int(vote)]
            p.append(like[1] / sum(like))
        new = [[], []]
        for k, (low, high) in enumerate(((0.0001, 0.05), (0.1, 0.9999))):
            for lab in range(4):
                weight = [x if k else 1 - x for x in p]
                junk, clean = (sum(w for w, row in zip(weight, v, strict=True) if row[lab] == vote) + 0.5 for vote in (2, 1))
                new[k].append(min(max(junk / (junk + clean), low), high))
        says, prior = new, sum(p) / len(p)
    assert abs(got.prior - prior) < 1e-9 and np.allclose(got.table[:, :, 2].T, says)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/labels.parquet"), reason="needs the test tables")
def test_quality_agrees_with_labels(spark):
    table_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = quality.judge(table_, quality.fit(spark, table_)).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("quality", "truth"), "doc_id")
    same, n = judged.agg(F.count_if(F.col("kept") == (F.col("truth") == 1)), F.count("*")).first()
    assert n > 100 and same >= 0.98 * n


def test_quality(spark, docs, empty):
    rng = random.Random(1)
    common, long = ["the", "of", "and", "a", "to", "in"], [f"{a}{b}{c}" for a in ("con", "tra", "per") for b in ("ven", "duc", "mit") for c in ("tion", "able", "ing")]
    good = lambda n: ". ".join(" ".join(rng.choices(common + long, k=9)).capitalize() for _ in range(n)) + "."
    bad = [lambda n: " | ".join(rng.choices(long, k=9 * n)), lambda n: " ".join(f"{w}%%%" for w in rng.choices(long, k=9 * n)), lambda n: " ".join([rng.choice(long)] * 9 * n), lambda n: " ".join(f"{w.upper()}!!" for w in rng.choices(common + long, k=9 * n))]
    data = [(i, good(rng.randrange(1, 20)), 1) if rng.random() < 0.8 else (i, rng.choice(bad)(rng.randrange(2, 20)), 0) for i in range(600)]
    table_ = spark.createDataFrame([*data, (900, None, 0), (901, " ", 0), (None, good(3), 1)], "doc_id long, text string, kept int")
    model = quality.fit(spark, table_)
    got = {r.doc_id: r for r in quality.judge(table_, model).collect()}
    assert np.mean([got[i].kept == bool(k) for i, _, k in data]) > 0.98
    assert not got[900].kept and not got[901].kept and got[None].kept and got[900].quality == 0
    kept = quality.keep_good(spark, table_)
    assert kept.columns == table_.columns and kept.count() == sum(r.kept for r in got.values())
    assert quality.judge(docs, quality.fit(spark, docs)).count() == len(table())
    texts = [t for _, t, _ in data]
    for share in (0.05, 0.2, 0.6, 0.8, 0.95):
        made = [(rng.choice(bad)(rng.randrange(2, 20)), 0) if rng.random() < share else (good(rng.randrange(1, 20)), 1) for _ in range(800)]
        data_, at = flat.buffers(pa.array([t for t, _ in made]))
        v = quality.votes(quality.statistics(data_, at))
        kinds, n = np.unique(quality.pattern(v), return_counts=True)
        weak = quality.expectation_maximisation(quality.unpattern(kinds), n.astype(float))
        x, clean = quality.features(data_, at), np.array([k for _, k in made], bool)
        w, b = quality.train(x, quality.posterior(weak, v))
        kept = 1 / (1 + np.exp(-np.clip(x @ w + b, -60, 60))) <= quality.REJECT_ABOVE
        assert abs(weak.prior - share) < 0.1 and (kept & ~clean).sum() <= 0.05 * (~clean).sum() and (~kept & clean).sum() <= max(3, 0.05 * clean.sum())
    # nothing but clean texts: all stay
    data_, at = flat.buffers(pa.array([t for t, (_, _, k) in zip(texts, data, strict=True) if k]))
    v = quality.votes(quality.statistics(data_, at))
    kinds, n = np.unique(quality.pattern(v), return_counts=True)
    weak = quality.expectation_maximisation(quality.unpattern(kinds), n.astype(float))
    w, b = quality.train(x := quality.features(data_, at), quality.posterior(weak, v))
    assert (1 / (1 + np.exp(-(x @ w + b))) <= quality.REJECT_ABOVE).mean() > 0.99
    assert quality.judge(docs, quality.fit(spark, empty)).filter("kept").count() == 0 and quality.judge(empty, model).count() == 0
