"""The numbered operators against brute force, and on nulls, empties, ties, repeats and clashing columns."""

import collections
from fractions import Fraction
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from memlake.llm import exact_dedup as ed
from memlake.llm import near_dedup as nd
from memlake.llm import token_store as ts
from memlake.llm.decontaminate import contaminated_passages, decontaminate
from memlake.llm.html_extract import main_text
from memlake.llm.langid import fit, identify
from memlake.llm.license_scan import scan_licenses
from memlake.llm.line_dedup import drop_recurring_lines
from memlake.llm.mixing import mix_sources, pfair_slots, whole_weights
from memlake.llm.sharding import communication_matrix, hypergeometric, shard_rows

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(300)]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], SHAPE)


ODD = [None, "", "  \n\t ", "one", "one", "Two words", "x" * 5000]


def sets(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(texts, n, percent=80):
    s = [sets(t, n) for t in texts]
    up = list(range(len(s)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(s))], [len(x) for x in s]


def family(seed, copies, edits, n=120):
    base, rng, out = prose(seed, n).split(), random.Random(seed), []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_equal_brute_force_also_in_large_buckets(spark):
    texts = ODD + family(1, 60, 9) + family(2, 6, 12) + [prose(i, 80) for i in range(10, 20)] + family(1, 3, 1)
    want, sizes = components(texts, 4)
    for bucket, block in ((32, 256), (3, 8)):
        got = {r["id"]: r for r in nd.near_duplicates(docs(spark, texts), shingle=4, bucket_pairs=bucket, block=block).collect()}
        assert [got[i]["component_id"] for i in range(len(texts))] == want
        assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
        assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_duplicates_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (5, "a b c d e")], "doc_id long, text string")
    rows = sorted((str(r["id"]), r["component_id"], r["kept"]) for r in nd.near_duplicates(df).collect())
    assert rows == [("3", 3, True), ("3", 3, True), ("5", 3, False), ("None", None, True)]
    assert nd.near_duplicates(df.limit(0)).count() == 0


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 600).astype(np.uint64)
    for share in (0.5, 0.8):
        cut = int(600 * (1 - share) / (1 + share))
        b = np.concatenate([a[cut:], rng.integers(0, 2**63, cut).astype(np.uint64)])
        s = nd.superminhash(np.concatenate([a, b]), np.array([0, 600, 1200]), 512)
        assert abs((s[0] == s[1]).mean() - share) < 0.08
    # Few elements need more levels, and still fill every position.
    few = nd.superminhash(a[:3], np.array([0, 3, 3]), 64)
    assert (few[0] < np.uint64(64 << 32)).all() and (few[1] == np.iinfo(np.uint64).max).all()


def test_common_sizes():
    rng = np.random.default_rng(5)
    a, b = ([np.unique(rng.integers(0, 50, 20)).astype(np.uint64) for _ in range(7)] for _ in range(2))
    assert nd.common_sizes(a, b, columns=8).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]


def test_quotient_filters_merge_without_loss():
    rng = random.Random(1)
    parts = [[rng.randrange(1 << 20) << 30 | rng.randrange(4) for _ in range(n)] for n in (0, 1, 5, 400, 3000)]
    parts[3] += parts[4][:50] * 3
    raw = []
    for p in parts:
        v, c = np.unique(np.array(p, np.uint64), return_counts=True)
        if len(v):
            raw.append(ed.encode_filter(v, c, 56))
            assert [x.tolist() for x in ed.decode_filter(raw[-1])] == [v.tolist(), c.tolist()]
    values, counts = ed.merge_filters(raw)
    assert dict(zip(values.tolist(), counts.tolist())) == collections.Counter(x for p in parts for x in p)


def test_exact_duplicates(spark):
    texts = ODD + ["a  b", "a b", "a\n b ", "a b "] + ["hot"] * 50
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    got = {r["id"]: r for r in ed.exact_duplicates(docs(spark, texts)).collect()}
    for i, n in enumerate(norm):
        same = [j for j, m in enumerate(norm) if m == n]
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (same[0], len(same), i == same[0], hashlib.sha256(n.encode()).hexdigest())
    nulls = spark.createDataFrame([(None, "q"), (4, "q"), (None, "z"), (None, "z")], "doc_id long, text string")
    got = sorted(((r["id"], r["keep_id"], r["kept"]) for r in ed.exact_duplicates(nulls).collect()), key=str)
    assert got == [(4, 4, True), (None, 4, False), (None, None, True), (None, None, True)]
    assert ed.exact_duplicates(nulls.limit(0)).count() == 0


PAGE = """<html><head><title>T</title></head><body><header><h2>Site</h2></header><nav><ul><li><a href=x>Home page link</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site</div>{open}<h1>Head &amp; line</h1><p>First   words of the &lt;story&gt;<br>go on here.<p>Second <b>bold part.
<div class="ad">Buy this thing now</div><p>Be.</p>{close}<aside>Side words here</aside><section class="comments"><p>Nice story I liked it</p></section>
<form><label>Your mail address</label></form><script>var x = "<p>no</p>";</script><footer>&copy; Site</footer></body></html>"""


@pytest.mark.parametrize("tag", ["<article>", "<main>", '<div class="content">', '<div id="post-body">'])
def test_html_main_text(spark, tag):
    page = PAGE.format(open=tag, close=f"</{re.match('<([a-z]+)', tag)[1]}>")
    df = spark.createDataFrame([(1, page, "old"), (2, None, ""), (3, "", ""), (4, "<nav>Menu only</nav>", "")], "page_id int, html string, text string")
    got = {r["page_id"]: r["text"] for r in main_text(df).collect()}
    assert got == {1: "Head & line\n\nFirst words of the <story> go on here.\n\nSecond bold part.\n\nBe.", 2: "", 3: "", 4: ""}


def test_hypergeometric_law():
    rng = random.Random(2)
    seen = collections.Counter(hypergeometric(rng, 5, 7, 4) for _ in range(20000))
    from math import comb
    for k in range(5):
        assert abs(seen[k] / 20000 - comb(5, k) * comb(7, 4 - k) / comb(12, 4)) < 0.015
    m = communication_matrix([10, 0, 7, 3], [7, 7, 6], 1)
    assert [sum(r) for r in m] == [10, 0, 7, 3] and [sum(c) for c in zip(*m)] == [7, 7, 6]


def test_shards(spark):
    df = docs(spark, ["t"] * 1001 + ODD).withColumn("shard", F.lit("old")).unionByName(docs(spark, [None]).withColumn("doc_id", F.lit(None).cast("long")).withColumn("shard", F.lit("x")))
    rows = shard_rows(df, ["doc_id"], shards=8, partitions=16).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    sizes = [len(v) for v in by.values()]
    assert len(by) == 8 and sum(sizes) == df.count() and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in shard_rows(df.repartition(7), ["doc_id"], shards=8, partitions=16).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}
    assert shard_rows(df.limit(0), ["doc_id"]).count() == 0


def _fluid(weights, blocks, t):
    """What each source has of slot t by plain water-filling: the active sources share each slot by weight."""
    have, left = dict.fromkeys(weights, Fraction(0)), Fraction(t)
    while left > 0 and any(have[s] < blocks[s] for s in weights):
        active = {s: weights[s] for s in weights if have[s] < blocks[s]}
        total = sum(active.values())
        step = min(left, min((blocks[s] - have[s]) * total / w for s, w in active.items()))
        for s, w in active.items():
            have[s] += step * w / total
        left -= step
    return have


@pytest.mark.parametrize("weights", [
    {"a": 500, "b": 301, "c": 150, "d": 48, "e": 1}, {s: n**0.8 for s, n in (("a", 40_000), ("b", 3_000), ("c", 777), ("d", 9))}, {"a": 0.3, "b": 0.3, "c": 0.399, "d": 0.001},
    {"hot": 0.5} | {f"s{i}": 0.005 for i in range(100)}, {"a": 1.0, "b": 1e-9, "c": 0.37}])
def test_pfair_stays_within_a_block_of_the_target(weights):
    exact = whole_weights(weights)
    blocks = {s: 1 + i * 400 % 977 for i, s in enumerate(weights)}
    slots = pfair_slots(blocks, exact)
    at = {t: s for s, v in slots.items() for t in v}
    assert sorted(at) == list(range(sum(blocks.values()))) and all(v == sorted(v) and len(v) == blocks[s] for s, v in slots.items())
    done = dict.fromkeys(weights, 0)
    for t in range(len(at)):
        done[at[t]] += 1
        if t < 300 or t % 97 == 0:
            due = _fluid(exact, blocks, t + 1)
            assert all(abs(done[s] - due[s]) < 1 for s in weights), t


def test_a_long_mix_does_not_drift():
    """A million slots of sources that weigh n ** 0.8: every prefix within one block of the target weights."""
    weights = {s: float(n) ** 0.8 for s, n in (("a", 5_000_000), ("b", 900_000), ("c", 40_000))}
    total = sum(weights.values())
    blocks = {s: int(1_000_000 * w / total) + 1 for s, w in weights.items()}
    slots = pfair_slots(blocks, whole_weights(weights))
    for s, v in slots.items():
        place, share = np.array(v[: blocks[s] - 2]), weights[s] / total
        k = np.arange(len(place))
        assert np.abs(k + 1 - share * (place + 1)).max() < 1 and np.abs(k - share * place).max() < 1


def test_mixing_keeps_every_row(spark):
    rows = [(i, "hot" if i < 700 else f"s{i % 5}" if i < 990 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("mix_slot", F.lit(0))
    got = mix_sources(df, ["doc_id"], block_rows=4).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1000)) and len({r["mix_order"] for r in got}) == 1000
    slots = collections.defaultdict(set)
    for r in got:
        slots[r["mix_slot"]].add(r["source"])
    assert all(len(v) == 1 for v in slots.values()) and sorted(slots) == list(range(len(slots)))
    named = mix_sources(df, ["doc_id"], weights={"hot": 1, "s1": 1}).collect()
    assert len(named) == 1000 and {r["source"] for r in named if r["in_mix"]} <= {"hot", "s1"}
    assert mix_sources(df.limit(0), ["doc_id"]).count() == 0


def test_decontamination(spark):
    items = [prose(1000 + n, n) for n in (3, 6, 13, 15, 20, 33, 47, 60, 150)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(99, None)], "item_id long, text string")
    hosts = [prose(i, 200).split() for i in range(40)]
    texts, want = list(ODD), set()
    for n, host in enumerate(hosts):
        i = n % len(items)
        at = 7 * n % 150
        text = host[:at] + items[i].upper().replace(" ", ",\n").split(" ") + host[at:]
        if n < 30:
            want.add((len(texts), i))
        else:  # half of an item is not the item
            half = items[8].split()[: 75 + n - 30]
            text = host[:at] + half + host[at:]
        texts.append(" ".join(text))
    df = docs(spark, texts)
    got = {(r["doc_id"], r["item_id"]) for r in contaminated_passages(df, bench, block_bytes=400).collect()}
    assert got == want
    clean = decontaminate(df, bench)
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in want} and clean.columns == df.columns
    assert decontaminate(df, bench.limit(0)).count() == len(texts) and contaminated_passages(df.limit(0), bench).count() == 0


EN, DE, RU = "the house is on the hill and we saw that it was good", "das haus ist auf dem berg und wir sahen dass es gut war", "дом стоит на горе и мы видели что он хороший"


def test_language_spans_and_und(spark):
    train = spark.createDataFrame([(i, t, k, i) for i, (t, k) in enumerate([(EN, "en"), (DE, "de"), (RU, "ru")] * 5)], "doc_id long, text string, lang string, score long")
    model = fit(train)
    asked = [(1, EN), (2, f"{EN}. {DE} {DE} {DE}"), (3, None), (4, ""), (5, "12 34 !! ×÷"), (6, "горе дом"), (7, "我们")]
    df = spark.createDataFrame(asked, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in identify(df, model, spans=True).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 6)] == ["en", "de", "und", "und", "und", "ru"]
    assert [s["lang"] for s in got[2]["lang_spans"]] == ["en", "de"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in identify(df, fit(train.limit(0))).collect()} == {"und"}
    assert identify(df.limit(0), model).count() == 0


def test_token_store_round_trip(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    texts = ODD + ["It's DON'T we'll 'S", "<|endoftext|> x<a>", "naïve Ünïcödé×÷ ßÿ 12ab3.4,,5 \x01c\x85d\xa0e　f", "日本語 한국어 🙂 ́ ΟΔΟΣ"] + [prose(i, 300) for i in range(9)]
    path = f"file://{tmp_path}/store"
    ts.write_token_store(docs(spark, texts), path, file, chunk_ids=500)
    got = sorted((r["id"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["tokens"]))) for r in ts.read_token_store(spark, path).collect())
    plain, start, want = Tokenizer.from_file(file), 0, []
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    for n in (0, 1, 9, 10, 25):
        ids = np.arange(n, dtype="<u4") * 70001
        assert (ts.decode_chunk(ts.encode_chunk(ids, block=10)) == ids).all()
    ts.write_token_store(docs(spark, texts).limit(0), path + "0", file)
    assert ts.read_token_store(spark, path + "0").count() == 0


def test_licenses(spark):
    long = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    texts = ODD + [f"{prose(1, 90)}\nReleased under the MIT license. {prose(2, 5)}", f"{prose(3, 33)} {long.upper()} {prose(4, 9)}", "All rights reserved", "Licensed under CC BY-NC 4.0.", "released the license under MIT"]
    got = {(r["doc_id"], r["license"]) for r in scan_licenses(docs(spark, texts)).collect()}
    n = len(ODD)
    assert got == {(n, "MIT"), (n + 1, "BSD"), (n + 2, "All-rights-reserved"), (n + 3, "CC-BY-NC-4.0")}
    assert scan_licenses(docs(spark, texts).limit(0)).count() == 0


def test_recurring_lines(spark):
    texts = list(ODD)
    for i in range(8):
        texts.append(f"{prose(i, 9)}\nPage {i} of twelve\n\nthe user name{chr(97 + i)} has logged in to this site today\n{prose(100 + i, 7)}")
    df = docs(spark, texts).withColumn("n_lines", F.lit("x"))
    got = {r["doc_id"]: r for r in drop_recurring_lines(df, min_docs=5).collect()}
    for i in range(8):
        assert got[len(ODD) + i]["text"] == f"{prose(i, 9)}\n\n{prose(100 + i, 7)}" and got[len(ODD) + i]["n_dropped"] == 2
    assert [got[i]["text"] for i in range(len(ODD))] == ODD and got[0]["n_lines"] == 0
    # Copies of one text count once.
    same = drop_recurring_lines(docs(spark, ["only line here"] * 9), min_docs=5).collect()
    assert {r["text"] for r in same} == {"only line here"}
    assert drop_recurring_lines(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    texts = ODD + [prose(i, 60) for i in range(30)] + [prose(3, 60), prose(4, 59)]
    bench = prose(500, 30)
    texts.append(f"{prose(77, 50)} {bench} {prose(78, 50)}")
    path = f"file://{tmp_path}"
    docs(spark, texts).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "benchmark_decontamination", "source_mixing", "sharding"]
    rows = corpus_pipeline.run(spark, path).collect()
    ids = sorted(r["doc_id"] for r in rows)
    gone = {0, 1, 2, 4, len(texts) - 1, len(texts) - 2, len(texts) - 3}
    assert len(set(ids)) == len(ids) and not set(ids) & gone and len(ids) >= 0.8 * (len(texts) - len(gone))
    assert {"shard", "slot", "text", "lang"} <= set(rows[0].asDict())


@pytest.mark.parametrize("page, want", [
    ("<video-player src=x></video-player><article>Body text</article>", "Body text"),
    ('<svg class="i"/><article>Body text</article>', "Body text"),
    ("<article>Body <video src=x> text <svg><svg><text>no</text></svg></svg> ends</article>", "Body text ends"),
    ("<article>Sum <math><mi>a</mi><mo>+</mo><mn>1</mn><annotation>a + 1</annotation></math> here</article>", "Sum a+1 here"),
    ("<article>Kept</article><script>var a = '<p>no</p>'", "Kept"),
    ('<div class="site header-fixed"><nav>Menu</nav><article>Body text of it</article><footer>Foot</footer></div>', "Body text of it"),
    ('<form id="f"><div class="layout sidebar"><main>Body text of it</main></div></form>', "Body text of it"),
    ('<div class="modal-ready"><p>Most of the words of this page</p></div><nav>Menu</nav>', "Most of the words of this page"),
    ('<article>The body is long enough to lead here</article><div class="comments"><article>Nice one</article><p>And many words more than the body has in all of its text</p></div>',
     "The body is long enough to lead here"),
    ('<div class="content"><p>One two three four five</p></div><div class="content"><p>Six seven eight</p></div>', "One two three four five\n\nSix seven eight"),
])
def test_html_keeps_whole_articles(spark, page, want):
    df = spark.createDataFrame([(1, f"<html><body>{page}</body></html>")], "page_id int, html string")
    assert main_text(df).first()["text"] == want


@pytest.mark.parametrize("copies", [2, 3, 4])
def test_long_passages_recur_from_two_texts_on(spark, copies):
    passage, notice = prose(900, 55), "我们" * 90
    fields = [f"{prose(901, 30)} name{chr(97 + i)} {prose(902, 25)}" for i in range(copies)]
    texts = [f"{prose(i, 9)}\n{passage}\nshort line here\n{fields[i]}\n{notice}\n{prose(100 + i, 55)}" for i in range(copies)] + [prose(50, 60), f"{prose(901, 15)} {prose(903, 41)}"]
    got = {r["doc_id"]: r for r in drop_recurring_lines(docs(spark, texts)).collect()}
    for i in range(copies):
        assert got[i]["text"] == f"{prose(i, 9)}\nshort line here\n{prose(100 + i, 55)}" and got[i]["n_dropped"] == 3
    assert [got[i]["text"] for i in (copies, copies + 1)] == texts[copies:]


FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
CLAUSES = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain "
           "the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
           "the following disclaimer in the documentation and/or other materials provided with the distribution. ")


def test_licenses_tell_rivals_apart(spark):
    cases = [
        ("This work is licensed under the GNU General Public License, version 2", {"GPL-2.0"}), ("Licensed under the GNU General Public License, version 2", {"GPL-2.0"}),
        ("Licensed under the GNU General Public License, version 3", {"GPL-3.0"}), ("Licensed under the GNU General Public License, version 3 or later", {"GPL-3.0-or-later"}),
        (FREE.format("General Public", 2), {"GPL-2.0-or-later"}), (FREE.format("General Public", 3), {"GPL-3.0-or-later"}), (FREE.format("Affero General Public", 3), {"AGPL-3.0-or-later"}),
        (FREE.format("Lesser General Public", "2.1"), {"LGPL-2.1-or-later"}), (FREE.format("General Public", 3).replace("either ", "").split(", or")[0], {"GPL-3.0-only"}),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1", {"MPL-1.1"}), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", {"MPL-2.0"}),
        (CLAUSES + "THIS SOFTWARE IS PROVIDED AS IS", {"BSD-2-Clause"}),
        (CLAUSES + "3. Neither the name of the Institute nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", {"BSD-3-Clause"}),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", {"CC-BY-SA-4.0"}),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License", {"CC-BY-4.0"}),
    ]
    texts = [f"{prose(i, 40 + i)} {t} {prose(90 + i, 30)}" for i, (t, _) in enumerate(cases)]
    got = collections.defaultdict(set)
    for r in scan_licenses(docs(spark, texts)).collect():
        got[r["doc_id"]].add(r["license"])
    assert [(cases[i][0], got[i]) for i in range(len(cases))] == cases
