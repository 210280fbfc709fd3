"""Brute-force versions of more operators, and nulls, repeats, long texts and clashing columns in all of them and in every stage."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from memlake.llm import exact_dedup as ed
from memlake.llm import html_extract as he
from memlake.llm import langid as li
from memlake.llm import license_scan as ls
from memlake.llm import mixing as mx
from memlake.llm import near_dedup as nd
from memlake.llm import sharding as sh
from memlake.llm import stages
from memlake.llm import token_store as ts
from memlake.llm.line_dedup import drop_recurring_lines

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, words=3000):
    rng = random.Random(seed)
    return " ".join(f"w{chr(97 + rng.randrange(26))}{rng.randrange(words)}x" for _ in range(n))


ARTICLE = "<h1>Head of it</h1><p>Some real words that make up the article.</p><p>And more of these words here.</p>"
PLAIN = "Head of it\n\nSome real words that make up the article.\n\nAnd more of these words here."


@pytest.mark.parametrize("opening", ['<div class="content has-sidebar">', '<div class="post has-comments">', '<div class="layout no-sidebar">', '<div class="article tags-on">', '<div id="page" class="page search">'])
def test_state_names_do_not_empty_a_page(opening):
    assert he.Extractor(*he.learned()).text(f"<body>{opening}{ARTICLE}</div></body>") == PLAIN


@pytest.mark.parametrize("block, want", [
    ('<p><span class="advert">AD</span> real tail words</p>', "real tail words"), ('<p><a class="share">x</a>Real words ...</p>', "Real words ..."),
    ('<p>Real start <span class="advert">AD</span> tail</p>', "Real start tail"), ('<p><span class="hl">A <span>plain</span> b</span> c</p>', "A plain b c"),
    ("<p><span class=ad>AD <i>x</span></i> tail</p>", "tail"), ('<div class="related">Read <b>this</b> too</div>', ""),
])
def test_labelled_elements_take_only_their_own_words(block, want):
    got = he.Extractor(*he.learned()).text(f"<article>{ARTICLE}{block}</article>")
    assert got == (f"{PLAIN}\n\n{want}" if want else PLAIN)


def test_best_run_equals_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        scores = [rng.choice([-3, -1, -0.5, 1, 2, 5]) for _ in range(rng.randrange(9))]
        a, b = he.best_run(scores)
        runs = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        assert sum(scores[a:b]) == max([0, *runs])


def test_pages_empty_long_repeated_and_clashing(spark):
    long = "<body><article>" + "".join(f"<p>Paragraph {i} has some words in it</p>" for i in range(30_000)) + "</article><footer>Foot</footer></body>"
    rows = [(1, long, "a"), (2, ARTICLE, "b"), (2, ARTICLE, "b"), (None, None, "c")]
    df = spark.createDataFrame(rows, "page_id int, html string, __html string").withColumn("__main", F.lit(1)).withColumn("text", F.lit("old"))
    got = he.main_text(df)
    assert got.columns == ["page_id", "html", "__html", "__main", "text"]
    out = [(r["page_id"], r["__html"], r["text"]) for r in got.collect()]
    assert sorted(out, key=str) == sorted([(1, "a", "\n\n".join(f"Paragraph {i} has some words in it" for i in range(30_000))), (2, "b", PLAIN), (2, "b", PLAIN), (None, "c", "")], key=str)
    assert he.main_text(df.limit(0)).count() == 0


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(60):
        sizes = rng.integers(0, 6, 4)
        cut = np.concatenate([[0], np.cumsum(sizes)])
        scores = rng.normal(size=(int(cut[-1]), 3)).astype(np.float32)
        got = li.viterbi(scores, cut, 1.0) if cut[-1] else []
        for a, b in zip(cut, cut[1:]):
            def worth(labels):
                return sum(scores[a + i, x] for i, x in enumerate(labels)) - sum(x != y for x, y in zip(labels, labels[1:]))
            if b > a:
                assert math.isclose(worth(got[a:b]), max(worth(x) for x in itertools.product(range(3), repeat=int(b - a))), abs_tol=1e-4)


SCRIPTS = {"dv": "ދިވެހި ރާއްޖެ", "zgh": "ⵜⴰⵎⴰⵣⵉⵖⵜ ⵜⴰⵏⴰⵡⴰⵢⵜ", "nqo": "ߒߞߏ ߞߊ߲", "cop": "ⲘⲈⲦⲢⲈⲘⲚⲬⲎⲘⲒ ⲡⲉ", "fw": "ＦＵＬＬ ｗｉｄｔｈ", "ar": "ﺍﻟﺴﻼﻡ ﻋﻠﻴﻜﻢ", "en": "the house on the hill"}


def test_letters_of_any_script_get_a_language(spark):
    train = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(list(SCRIPTS.items()) * 3)], "doc_id long, text string, lang string")
    model = li.fit(train)
    asked = [(k, t) for k, t in SCRIPTS.items()] + [(None, x) for x in ("“ ” – …", "™ € ↑", "§ 12 ×", "", None)] + [("any", "Ɐ ʰ ꟹ"), ("any", "𐌰𐌱")]
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(asked)], "doc_id long, want string, text string").withColumn("__text", F.lit(1)).withColumn("__pred", F.lit(2)).withColumn("__score", F.lit(3))
    got = li.identify(df, model)
    assert got.columns == [*df.columns, "lang_pred", "score"]
    for r in got.collect():
        if r["want"] == "any":
            assert r["lang_pred"] in SCRIPTS
        else:
            assert r["lang_pred"] == (r["want"] or "und") and (r["want"] or r["score"] == 0)


def test_long_and_repeated_texts_have_a_language(spark):
    train = spark.createDataFrame([(1, "the house is on the hill", "en"), (2, "das haus ist auf dem berg", "de")] * 4, "doc_id long, text string, lang string")
    rows = [(1, "the hill " * 60_000), (2, "das haus"), (2, "das haus"), (None, "das haus")]
    got = [(r["doc_id"], r["lang_pred"]) for r in li.identify(spark.createDataFrame(rows, "doc_id long, text string"), li.fit(train)).collect()]
    assert Counter(got) == Counter([(1, "en"), (2, "de"), (2, "de"), (None, "de")])


def plain_shingles(text, size):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def test_license_containment_equals_brute_force_over_windows(spark):
    rng = random.Random(6)
    templates = [(f"L{i}", prose(700 + i, rng.choice([9, 14, 30, 70, 150]), 60)) for i in range(30)]
    texts = []
    for i in range(90):
        words = templates[i % 30][1].split()
        for _ in range(rng.randrange(1 + len(words) // 40)):
            words[rng.randrange(len(words))] = "edited"
        texts.append(f"{prose(i, rng.randrange(60), 60)} {' '.join(words)} {prose(200 + i, rng.randrange(60), 60)}")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r["doc_id"], r["template"]): r["containment"] for r in ls.scan_licenses(df, templates=templates).collect()}
    due = {}
    for d, text in enumerate(texts):
        seen = plain_shingles(text, 5)
        for t, (_, wording) in enumerate(templates):
            own = set(plain_shingles(wording, 5))
            share = max(len(own & set(seen[i : i + len(own)])) / len(own) for i in range(max(1, len(seen) - len(own) + 1)))
            if share >= 0.8:
                due[d, t] = share
    assert len(due) > 60 and set(due) <= set(got) and all(got[k] >= due[k] - 1e-9 for k in due)
    assert all(len(set(plain_shingles(templates[t][1], 5)) & set(plain_shingles(texts[d], 5))) >= 0.8 * len(set(plain_shingles(templates[t][1], 5))) for d, t in got)


@pytest.mark.parametrize("name, text", ls.WHOLE_TEXTS)
def test_whole_license_texts(spark, name, text):
    text = re.sub("[{}]", "", text)
    df = spark.createDataFrame([(1, f"Copyright (c) 2020 Someone\n\n{text}\n"), (1, f"{prose(3, 30)} {text.upper()} {prose(4, 30)}"), (2, None)], "doc_id long, text string").withColumn("id", F.lit("x"))
    found = ls.scan_licenses(df).where(F.col("template") >= ls.NOTICES).collect()
    assert Counter((r["doc_id"], r["license"]) for r in found).keys() == {(1, name)} and sum(r["containment"] == 1 for r in found) >= 2


def long_line_rule(texts, min_docs=5, long_tokens=20):
    """First-round line dedup by plain Python: lines with digit tokens generalised, texts counted once."""
    def template(line):
        raw = line.split()
        loose = ["<*>" if re.search("[0-9]", t) else t for t in raw]
        return tuple(loose if 2 * sum(t != "<*>" for t in loose) >= len(loose) else raw)
    seen = defaultdict(set)
    for t in texts:
        for line in t.split("\n"):
            if line.strip():
                seen[template(line)].add(t)
    def gone(line):
        k = template(line)
        return bool(k) and len(seen[k]) >= (2 if len(k) >= long_tokens or len(" ".join(k)) >= 6 * long_tokens else min_docs)
    return ["\n".join(x for x in t.split("\n") if not gone(x)) for t in texts]


def test_first_round_of_line_dedup_equals_brute_force(spark):
    rng = random.Random(8)
    common = [f"{w} menu entry" for w in ("home", "news", "sport", "shop")] + ["page 12 of many", "3 4 5 x", " ".join(f"long{chr(97 + i)}" for i in range(22)), "one1 two2 three"]
    texts = []
    for i in range(60):
        lines = [" ".join(f"u{chr(97 + rng.randrange(26))}{''.join(rng.choice('abcdefgh') for _ in range(7))}" for _ in range(rng.randrange(3, 8))) for _ in range(3)]
        lines += [re.sub("12", str(rng.randrange(99)), x) for x in common if rng.random() < (0.5 if x != common[0] else 0.04)]
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    texts += texts[:9]
    got = {r["doc_id"]: r["text"] for r in drop_recurring_lines(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == long_line_rule(texts)


def test_line_dedup_repeats_clashes_and_long_texts(spark):
    line = " ".join(f"tok{chr(97 + i)}" for i in range(24))
    long = "\n".join([*(prose(i, 6) for i in range(20_000)), line])
    rows = [(1, f"first own\n{line}"), (1, f"first own\n{line}"), (1, "another text of the id"), (None, f"{line}\nend"), (2, long), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__t1", F.lit(1)).withColumn("__lost", F.lit(2)).withColumn("n_lines", F.lit("old"))
    got = drop_recurring_lines(df)
    assert got.columns == ["doc_id", "text", "__t1", "__lost", "n_lines", "n_dropped"]
    out = Counter((r["doc_id"], r["text"], r["n_dropped"]) for r in got.collect())
    assert out == Counter([(1, "first own", 1), (1, "first own", 1), (1, "another text of the id", 0), (None, "end", 1), (2, long[: -len(line) - 1], 1), (3, None, 0)])


def plain_edf(share, slots):
    """Earliest deadline first by a plain loop; ties by name."""
    total, done, out = sum(share.values()), dict.fromkeys(share, 0), []
    for t in range(slots):
        ready = [s for s in sorted(share) if done[s] * total // share[s] <= t]
        s = min(ready, key=lambda s: (-(-(done[s] + 1) * total // share[s]), s))
        done[s] += 1
        out.append(s)
    return out


def test_given_weights_are_exact_and_slots_follow_plain_edf(spark):
    weights = {"a": 0.5, "b": 0.3, "c": 0.175, "d": 0.025}
    rows = [(i, s) for i, s in enumerate(s for s, n in (("a", 400), ("b", 300), ("c", 200), ("d", 90)) for _ in range(n))]
    got = mx.mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), ["doc_id"], weights=weights, block_rows=2).collect()
    assert {r["source"]: round(r["mix_weight"], 9) for r in got} == weights
    at = {r["mix_slot"]: r["source"] for r in got if r["mix_slot"] < 390}
    assert [at[t] for t in range(390)] == plain_edf({"a": 20, "b": 12, "c": 7, "d": 1}, 390)
    assert mx.whole_weights({"a": 1.0, "b": 1e-9}) == {"a": 10**9, "b": 1} and mx.whole_weights({"a": 0.7, "b": 0.3}) == {"a": 7, "b": 3}


def test_a_null_source_is_not_the_empty_one(spark):
    rows = [(i, (None, "", "a")[i % 3]) for i in range(600)]
    got = mx.mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), ["doc_id"], weights={None: 0.5, "": 0.2, "a": 0.3}, block_rows=2).collect()
    assert {r["source"]: r["mix_weight"] for r in got} == {None: 0.5, "": 0.2, "a": 0.3}
    early = Counter(r["source"] for r in got if r["mix_slot"] < 100)
    assert early == {None: 100, "": 40, "a": 60}
    assert all((r["mix_slot"] < 200) == r["in_mix"] for r in got)  # the null source, half of the weight, ends at slot 200


def test_blocks_grow_so_that_their_number_is_bounded(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "IF(id < 4000, 'a', 'b') AS source")
    got = mx.mix_sources(df, ["doc_id"], most_blocks=50, block_rows=4).collect()
    assert max(r["mix_slot"] for r in got) == 49 and len({r["mix_order"] for r in got}) == 5000 and max(Counter(r["mix_slot"] for r in got).values()) == 100


def test_many_light_sources_share_a_pool(spark):
    names = [f"s{i}" for i in range(450)] * 8 + ["hot"] * 2080 + [None] * 320
    rows = [(i % 900 if i % 5 else None, s, "x") for i, s in enumerate(names)]
    df = spark.createDataFrame(rows, "doc_id long, source string, __n string").withColumn("__ph", F.lit("kept")).withColumn("h", F.monotonically_increasing_id())
    got = mx.mix_sources(df, ["doc_id", "h"], block_rows=2, most_sources=16)
    assert got.columns == [*df.columns, "mix_weight", "mix_block", "mix_slot", "mix_order", "in_mix"]
    out = got.collect()
    assert len(out) == 6000 and sorted({r["mix_slot"] for r in out}) == list(range(len({r["mix_slot"] for r in out}))) and len({r["mix_order"] for r in out}) == 6000
    by = defaultdict(set)
    for r in out:
        by[r["mix_slot"]].add(r["source"])
    assert all(len(v) == 1 for v in by.values())
    done, due = Counter(), {r["source"]: r["mix_weight"] for r in out}
    last = max(r["mix_slot"] for r in out if r["in_mix"] and r["source"] == "hot")
    for t in range(min(last, 1200)):
        done[next(iter(by[t]))] += 1
        assert abs(done["hot"] - due["hot"] * (t + 1)) < 1
        assert all(abs(done[s] - due[s] * (t + 1)) < 2.5 for s in by[t])
    assert mx.mix_sources(df.limit(0), ["doc_id"]).count() == 0


def test_shards_of_repeated_ids_and_clashing_names(spark):
    df = spark.createDataFrame([(i % 50 if i % 3 else None, prose(i, 3)) for i in range(500)], "doc_id long, text string").withColumn("__p", F.lit("a")).withColumn("__g0", F.lit("b")).withColumn("__r", F.lit(1))
    out = sh.shard_rows(df, ["doc_id", "text"], shards=7, partitions=9)
    assert out.columns == [*df.columns, "shard", "slot"]
    rows = out.collect()
    assert Counter(tuple(r)[:5] for r in rows) == Counter(map(tuple, df.collect()))
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert sorted(len(v) for v in by.values()) == [71] * 4 + [72] * 3 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_every_shard_gets_its_share_of_every_source(spark):
    rows = sh.shard_rows(spark.range(8000).selectExpr("id AS doc_id", "IF(id < 4000, 'a', 'b') AS source"), ["doc_id"]).collect()
    seen = Counter((r["shard"], r["source"]) for r in rows)
    assert all(abs(seen[s, "a"] - 500) < 80 for s in range(8))  # 5 standard deviations
    half = Counter(r["source"] for r in rows if r["slot"] < 500)
    assert abs(half["a"] - 2000) < 160


def test_other_tokenizers_encode_whole_texts(spark, tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    got = json.loads(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).to_str())
    assert ts.cuts_as_known(json.dumps(got))
    got["normalizer"]["normalizers"].pop()  # keeps capitals
    assert not ts.cuts_as_known(json.dumps(got))
    file = f"{tmp_path}/other.json"
    open(file, "w").write(json.dumps(got))
    rows = [(2, "Some CAPITALS here"), (2, "Other Words"), (None, "x"), (5, "word " * 200_000), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("h", F.lit("clash"))
    ts.write_token_store(df, f"file://{tmp_path}/store", file)
    plain = Tokenizer.from_file(file)
    out = ts.read_token_store(spark, f"file://{tmp_path}/store").collect()
    want = Counter((i, zlib.crc32(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for i, t in rows)
    assert Counter((r["id"], zlib.crc32(bytes(r["tokens"]))) for r in out) == want
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in out)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_exact_and_near_dedup_long_and_clashing(spark):
    long = prose(1, 150_000)
    rows = [(4, long), (2, long.replace(" ", "\t ")), (9, "short"), (None, "short"), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("norm", F.lit(1)).withColumn("fp", F.lit(2)).withColumn("id", F.lit(3)).withColumn("node", F.lit(4))
    got = Counter((r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in ed.exact_duplicates(df).collect())
    assert got == Counter([(4, 2, 2, False), (2, 2, 2, True), (9, 9, 2, True), (None, 9, 2, False), (9, 9, 1, True)])
    near = Counter((r["id"], r["component_id"], r["kept"]) for r in nd.near_duplicates(df).collect())
    assert near == Counter([(4, 2, False), (2, 2, True), (9, 9, True), (None, None, True), (9, 9, True)])


def plain_groups(rows, size=5):
    """Which rows the near_dedup stage keeps, by plain Python over all pairs."""
    def grams(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    sets, up = [grams(r[1]) for r in rows], list(range(len(rows)))
    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            up[root(j)] = root(i)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    return groups, sets


def test_near_dedup_stage_keeps_one_row_of_each_group(spark):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(1, a), (3, a), (3, b), (5, a), (5, a), (6, c), (6, c), (None, prose(4, 40)), (None, prose(4, 40) + " end"), (None, prose(5, 40)), (8, None), (8, None), (9, ""), (3, prose(6, 30)), (2, b + " more")]
    df = spark.createDataFrame([(i, t, "en", None, n) for n, (i, t) in enumerate(rows)], SHAPE).withColumn("__row_hash", F.lit("x"))
    out = stages.near_dedup(spark, df, "")
    assert out.columns == df.columns
    kept = sorted(r["n_chars"] for r in out.collect())
    groups, sets = plain_groups(rows)
    for members in groups.values():
        left = [i for i in members if i in kept]
        if not sets[members[0]]:
            assert left == members
        else:
            assert len(left) == 1 and all(rows[left[0]][0] is not None and (rows[i][0] is None or rows[left[0]][0] <= rows[i][0]) or rows[i][0] is None for i in members)
    assert stages.near_dedup(spark, df.limit(0), "").count() == 0


def test_stages_with_repeated_and_null_ids(spark, tmp_path):
    train = ["the house is on the hill and we saw it", "das haus ist auf dem berg und wir sahen es"]
    rows = [(i % 7 if i % 4 else None, f"{train[i % 2]} {prose(i, 20)}", [None, "en", "de"][(i % 2 + 1) * (i % 3 > 0)], f"s{i % 3}" if i % 5 else None, i) for i in range(120)]
    rows += [rows[0], rows[0], (1, None, "en", "s1", 500), (None, "", None, None, 501), (2, "12 34", "en", "s1", 502)]
    bench = prose(900, 25)
    rows += [(3, f"{train[0]} {bench} {train[0]}", "en", "s0", 503)]
    df = spark.createDataFrame(rows, SHAPE).withColumn("__text", F.lit(1)).withColumn("__s", F.lit(2)).withColumn("in_mix_", F.lit(3))
    spark.createDataFrame([(1, bench), (1, bench), (2, None)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    all_rows = Counter(tuple(r) for r in df.collect())
    lettered = stages.language_id(spark, df, "")
    assert lettered.columns == df.columns and Counter(r["n_chars"] for r in lettered.collect()) == Counter(r[4] for r in rows if r[4] not in (500, 501, 502))
    assert all(r["lang"] for r in lettered.collect())
    clean = stages.benchmark_decontamination(spark, df, f"file://{tmp_path}")
    assert clean.columns == df.columns and Counter(tuple(r) for r in clean.collect()) == all_rows - Counter({k: 1 for k in all_rows if k[4] == 503})
    mixed = stages.source_mixing(spark, df, "")
    assert mixed.columns == df.columns and not Counter(tuple(r) for r in mixed.collect()) - all_rows
    plan = Counter((r["source"], r["in_mix"]) for r in mx.mix_sources(df, ["doc_id", "text"], power=stages.MIX_POWER).collect())
    assert Counter(r["source"] for r in mixed.collect()) == Counter({s: n for (s, x), n in plan.items() if x})
    dealt = stages.sharding(spark, df, "")
    assert dealt.columns == [*df.columns, "shard", "slot"] and Counter(tuple(r)[: len(df.columns)] for r in dealt.collect()) == all_rows
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, df.limit(0), f"file://{tmp_path}").count() == 0, name


def test_a_chain_of_near_copies_is_one_component(spark):
    """2,000 texts, each shifted by three words against the one before: links are 37 of 43 shingles; plain union-find over them."""
    from memlake.llm.near_dedup import near_duplicates

    rng = random.Random(9)
    words = [f"w{rng.randrange(10**9)}" for _ in range(2000 * 3 + 40)]
    texts = [" ".join(words[3 * i : 3 * i + 40]) for i in range(2000)]
    sets = [{tuple(t.split()[j : j + 4]) for j in range(37)} for t in texts]
    assert 100 * len(sets[0] & sets[1]) >= 80 * len(sets[0] | sets[1]) and 100 * len(sets[0] & sets[2]) < 80 * len(sets[0] | sets[2])
    ids = list(range(1, 2001))
    rng.shuffle(ids)
    cut = {500, 501, 1200}  # texts left out: the chain falls into pieces
    rows = [(ids[i], t) for i, t in enumerate(texts) if i not in cut]
    want = {}
    for low, high in ((0, 500), (502, 1200), (1201, 2000)):
        want |= {ids[i]: min(ids[low:high]) for i in range(low, high)}
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4, percent=80).collect()
    assert {r.id: r.component_id for r in found} == want


STORY = "word " * 59 + "word"


@pytest.mark.parametrize("page, want", [
    (f'<nav><a>x</a></nav><article class="post"><header class="entry-header"><h1 class="entry-title">My Headline Here</h1></header><div class="entry-content"><p>{STORY}</p></div></article>', f"My Headline Here\n\n{STORY}"),
    (f'<article><div class="entry-header"><h1>My Headline</h1></div><p>{STORY}</p></article>', f"My Headline\n\n{STORY}"),
    (f'<article><div class="article-header"><h2>My Headline</h2><p>by me</p></div><p>{STORY}</p></article>', f"My Headline\n\nby me\n\n{STORY}"),
    (f'<article><div class="header"><h1>My Headline</h1></div><p>{STORY}</p></article>', f"My Headline\n\n{STORY}"),
    (f'<div class="header"><h1>Site Name</h1><ul><li><a>Home</a></li></ul></div><article><h1>Head</h1><p>{STORY}</p></article>', f"Head\n\n{STORY}"),
    (f"<div>We use cookies. Accept all</div><article><h1>Head</h1><p>{STORY}</p></article>", f"Head\n\n{STORY}"),
    (f"<main><h1>Head</h1><p>{STORY}</p><p>Copyright 2024 Example Inc</p></main>", f"Head\n\n{STORY}"),
    (f'<main><h1>Head</h1><p>{STORY}</p><section><h3>3 Comments</h3><div class="c-item">Nice one there</div><div class="c-item">Agreed</div></section></main>', f"Head\n\n{STORY}"),
    (f"<article><h1>Head</h1><p>{STORY}</p><p>We use cookies to bake with.</p><p>{STORY}</p><p>All rights reserved.</p></article>", f"Head\n\n{STORY}\n\nWe use cookies to bake with.\n\n{STORY}\n\nAll rights reserved."),
    ("<main><p>Copyright 2024 Example Inc</p></main>", "Copyright 2024 Example Inc"),
])
def test_headlines_stay_and_clutter_without_a_name_goes(page, want):
    assert he.Extractor(*he.learned()).text(f"<body>{page}</body>") == want


@pytest.mark.parametrize("text, want", [
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: see COPYING", {"BSD"}),
    ("This is not licensed under the MIT License, whatever it says", set()), ("It is licensed under the MIT License", {"MIT"}),
    ("// SPDX-License-Identifier: GPL-3.0-only\nint main;", {"GPL-3.0-only"}), ("# SPDX-License-Identifier: GPL-3.0", {"GPL-3.0"}), ("/* SPDX-License-Identifier: Apache-2.0 */ x", {"Apache-2.0"}),
    ("SPDX-License-Identifier: MIT\n\nSPDX-License-Identifier: BSD-2-Clause-Patent", {"MIT", "BSD-2-Clause-Patent"}), ("identifier of a license: MIT", set())])
def test_families_identifiers_and_negation(spark, text, want):
    assert {r["license"] for r in ls.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()} == want


def test_license_ids_and_long_repeated_rows(spark):
    assert len({n for n, _ in ls.TEMPLATES}) >= 100
    long = "filler words of a text " * 40_000 + "Licensed under the MIT License"
    rows = [(1, long, "x"), (1, long, "x"), (None, "Licensed under the MIT License", "y"), (2, None, "z")]
    got = ls.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    assert sorted(((r["doc_id"], r["license"]) for r in got), key=str) == [(1, "MIT"), (1, "MIT"), (None, "MIT")]
