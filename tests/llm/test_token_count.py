"""Token counts (op11) against the tokenizers library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from memlake.llm.token_count import WHITE, Transducer, token_counts

FILE = public_tokenizers.path("byte_bpe_50k.json")
HAND = ["", " ", "  ", "it's we're I'll 'sabc 'rx 'r9 'll''s", "a  b\n\n c \t d", "x<|endoftext|> y  <|endoftext|><|endoftext|>", "a" * 95, "日本語のテキスト。", "  　 a", "' 's '", "don't DON'T'S",
        "\r\n\r\n  x", "😀😀", "'r", "'re're", " '", "12'3 a'1", "\x1c\x1d a\x85b", "<|endoftext", "ẞé́ x"]


@pytest.fixture(scope="module")
def machine():
    return Transducer(FILE)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(FILE)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def _random_texts(n, seed):
    r = random.Random(seed)
    parts = [*" \n\t'  srevltdmabcthe1290!?.-_<|>é 日語ß😀  ", "<|endoftext|>", "the", "ing", " 's", "'ll"]
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(n)]


def test_counts_equal_the_library(machine, library):
    for text in HAND + _random_texts(4000, 1):
        assert machine.count(text) == library(text), text


def test_states_may_be_forgotten(library):
    small = Transducer(FILE, most_states=50)
    for text in _random_texts(300, 2):
        assert small.count(text) == library(text)
        small.trim()
        assert len(small.states) <= 50


def test_maps_compose_in_any_order(machine, library):
    r = random.Random(3)
    for text in HAND + _random_texts(600, 3):
        chunks = list(machine.chunks(text, r.randint(1, 9)))
        assert "".join(chunks) == text
        maps = [machine.chunk_map(c) for c in chunks]
        assert machine.total(machine.fold(maps)) == library(text)
        if maps:
            left = maps[0]
            for m in maps[1:]:
                left = machine.compose(left, m)
            right = maps[-1]
            for m in reversed(maps[:-1]):
                right = machine.compose(m, right)
            assert machine.total(left) == machine.total(right) == library(text)


def test_prefix_scan_gives_every_prefix(machine, library):
    text = "Ein Satz, it's 12 words<|endoftext|> und  mehr\n\n " * 4
    chunks = list(machine.chunks(text, 7))
    for i, whole in enumerate(machine.scan([machine.chunk_map(c) for c in chunks])):
        assert machine.total(whole) == library("".join(chunks[: i + 1]))


def test_a_special_token_is_never_cut(machine):
    assert all("<|endoftext|>" in c or "<" not in c for n in range(1, 30) for c in machine.chunks("ab<|endoftext|><|endoftext|>cd" * 3, n))


def test_white_space_is_the_librarys(machine):
    import re

    white = re.compile(f"[{WHITE}]").match
    assert all((machine.kind(chr(i)) == "S") == bool(white(chr(i))) for i in [*range(0x3100), 0xFEFF, 0x1F600])


def test_other_kinds_of_tokenizer_are_refused():
    with pytest.raises(ValueError):
        Transducer(public_tokenizers.path("word_bpe_49k.json"))


def test_table_of_odd_rows(spark, library):
    long_text = ("Langer Text 12, it's <|endoftext|> x" * 400) + "y" * 900 + "日" * 500
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", "a"), (3, "one two", "a"), (None, "x<|endoftext|>", None), (4, long_text, "b"), (4, long_text, "b"), (5, " \n ", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = token_counts(docs, FILE, chunk_chars=50, span_chars=600, limit=2).collect()
    want = [(i, len((t or "").encode()), library(t or "")) for i, t, _ in rows]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.id, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(want, key=key)
    assert all(r.over_limit == (r.n_tokens > 2) for r in got)
    assert token_counts(docs.limit(0), FILE).count() == 0


def test_query_equals_the_library(spark, library):
    from memlake.llm.queries import QUERIES

    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op11_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert got == {d.doc_id: (len((d.text or "").encode()), n := library(d.text or ""), n > 1024) for d in docs}
