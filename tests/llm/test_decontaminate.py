"""Decontamination against brute force over all passages."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memlake.llm import decontaminate as dc
from memlake.llm import textvec as tv

SHINGLE, LEAST = 5, 0.8


def block(items):
    """The arguments of an index over the items, with counts by plain Python."""
    grams = []
    for text in items:
        data, offsets = tv.utf8(pa.array([text]))
        words, of_row = dc.words_of(tv.LOWER[data], offsets)
        grams.append(set(tv.shingles(words, of_row, SHINGLE)[0].tolist()))
    counts = [[(int(np.uint64(s).view(np.int64)), sum(s in g for g in grams)) for s in own] for own in grams]
    return list(range(len(items))), items, counts, len(items)


def word_list(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def best(item, host):
    """The highest Jaccard of 5-word shingles over all passages one word shorter to one longer (all items distinct: equal weights)."""
    own = {tuple(item[i : i + 5]) for i in range(len(item) - 4)} or {tuple(item)}
    top = 0.0
    for n in (len(item) - 1, len(item), len(item) + 1):
        for s in range(len(host) - n + 1):
            p = host[s : s + n]
            got = {tuple(p[i : i + 5]) for i in range(n - 4)} or {tuple(p)}
            top = max(top, len(own & got) / len(own | got))
    return top


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 9, 11, 12, 15, 18, 20, 25, 30, 40, 60, 120, 200])
def test_recall_of_edited_passages(n):
    rng = random.Random(n)
    found, due, wrong = 0, 0, 0
    items = [word_list(rng, n) for _ in range(60)]
    index = dc.Benchmark(*block([" ".join(w) for w in items]), SHINGLE, LEAST)
    for i, item in enumerate(items):
        copy, at = list(item), rng.randrange(n)
        kind = i % 4
        if kind == 1:
            copy[at] = "edited"
        elif kind == 2:
            copy.insert(at, "edited")
        elif kind == 3 and n > 1:
            del copy[at]
        if kind and i % 8 > 3 and n > 2:  # at an end as often as anywhere
            copy = item[: n - 1] + ["edited"] if kind == 1 else item[1:] if kind == 3 else ["edited", *item]
        host = word_list(rng, rng.randrange(40)) + copy + word_list(rng, rng.randrange(40))
        data, offsets = tv.utf8(pa.array([" ".join(host)]))
        got = index.matches(*dc.words_of(tv.LOWER[data], offsets))
        top = best(item, host)
        due += top >= LEAST
        found += top >= LEAST and (0, i) in got and got[0, i][0] >= top - 1e-9
        wrong += sum(1 for _, j in got if best(items[j], host) < LEAST and slack_misses(items[j], host))
    assert due >= 15 and found >= 0.97 * due and wrong == 0, (n, found, due, wrong)


def slack_misses(item, host):
    """No passage of any length counts either."""
    own = {tuple(item[i : i + 5]) for i in range(len(item) - 4)} or {tuple(item)}
    for a in range(len(host)):
        for z in range(a + 1, min(len(host), a + 2 * len(item) + 5) + 1):
            p = host[a:z]
            got = {tuple(p[i : i + 5]) for i in range(len(p) - 4)} or {tuple(p)}
            if len(own & got) >= LEAST * len(own | got):
                return False
    return True


def test_weights_do_not_depend_on_blocks(spark):
    rng = random.Random(4)
    frame = word_list(rng, 12)
    items = [" ".join(frame + word_list(rng, 14)) for _ in range(30)]
    docs = [(i, " ".join(word_list(rng, 9) + t.split()[: 20 + i % 7] + word_list(rng, 5))) for i, t in enumerate(items)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    one, many = (sorted(map(tuple, dc.contaminated_passages(df, bench, block_bytes=b).collect())) for b in (1 << 20, 600))
    assert one == many and one
    # The weighted similarity itself, by plain Python over all passages.
    def weight(s):
        import math
        return math.log1p(len(items) / max(1, sum(s in {tuple(t.split()[i : i + 5]) for i in range(22)} for t in items)))
    for doc, item, share, first, words in one[:4]:
        own = {tuple(items[item].split()[i : i + 5]) for i in range(22)}
        p = docs[doc][1].split()[first : first + words]
        got = {tuple(p[i : i + 5]) for i in range(len(p) - 4)}
        rare = weight(("none",))
        assert abs(share - sum(map(weight, own & got)) / (sum(map(weight, own)) + rare * len(got - own))) < 1e-9


def test_scripts_without_spaces_and_signs(spark):
    zh = "今天的天气非常好我们一起去公园散步吧然后回家吃饭"
    th = "วันนี้อากาศดีมากเราไปเดินเล่นที่สวนสาธารณะ"
    bench = spark.createDataFrame([(1, zh), (2, th), (3, "Yes"), (4, "...")], "item_id long, text string")
    docs = [(1, f"前文在这里。“{zh[:10]}、{zh[10:]}”还有更多的字"), (2, f"ก่อนหน้า {th} ข้างหลัง"), (3, "well, yes it is"), (4, "... nothing"), (5, zh[:8]), (6, None), (None, zh)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.contaminated_passages(df, bench).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (None, 1)}


def test_clashing_names_repeats_and_long_texts(spark):
    rng = random.Random(9)
    item = " ".join(word_list(rng, 40))
    long = " ".join(word_list(rng, 300_000) + item.split() + word_list(rng, 50))
    rows = [(1, "fine words here", "a"), (1, "fine words here", "a"), (2, long, "b"), (3, item, "c"), (3, item, "c"), (None, None, "d"), (4, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string").withColumn("__text", F.lit("x")).withColumn("__TEXT_", F.lit(1))
    bench = spark.createDataFrame([(7, item), (7, item), (8, None)], "item_id long, text string").withColumn("id", F.lit("z"))
    clean = dc.decontaminate(df, bench)
    assert clean.columns == df.columns
    assert sorted(r["item_id"] for r in clean.collect()) == ["a", "a", "d", "e"]
    found = [(r["doc_id"], r["item_id"], r["first_word"], r["words"]) for r in dc.contaminated_passages(df, bench).collect()]
    assert sorted(found) == [(2, 7, 300_000, 40), (3, 7, 0, 40), (3, 7, 0, 40)]
