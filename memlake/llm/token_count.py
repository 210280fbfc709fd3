"""Token counts by a compiled finite-state transducer (operator 11).

A byte-level BPE tokenizer is compiled into one deterministic transducer over
characters.  A transition carries the change that its character makes to the
number of tokens of the text read so far, as if the text ended there (so it may
be negative: "t" and "h" are two tokens, "th" is one).  The sum of the numbers
along a text is its token count.

* The cutting of a text into pieces (letters, digits, other signs, white space,
  contractions) is a small automaton over character classes; a class is found by
  asking the library's own pre-tokenizer once for each character seen.
* Inside a piece a state knows every place from which the last bytes might
  still grow into one token, with the last token before that place and the
  tokens counted up to it.  Of two tokens side by side, BPE keeps both exactly if
  it keeps them when they stand alone, so the last token of every prefix is
  unique and found from these places.  The library's BPE model says so for each
  pair, once.

States and transitions are compiled when a text first asks for them and kept up
to ``MOST_STATES``; then the table starts afresh.  The path of a whole unit (a
word with the blanks before it) from the initial state is kept as one transition,
too, since most units come again.

A text is cut into chunks.  The state map of a chunk that starts in an unknown
state needs no list of states: at certain places (a blank after a word, a digit
after a letter, ...) every state goes on as the initial one does.  So a map is
``(head, body, tail)``: the characters before the first such place, the number of
tokens from there to the last such place, and the characters after it.  Maps
compose associatively, which a prefix scan in log steps uses.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm.token_store import _byte_letters
from memlake.plans.shared import SharedStage

MOST_STATES = 300_000
#: Nodes with so many tokens below are asked whether any of them could stay.
FEW = 8
#: The parts of a tokenizer file that the automaton is written for.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
WHITE = "\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CONTRACTIONS = ["'s", "'t", "'m", "'d", "'re", "'ve", "'ll"]

Map = tuple[str, int, str | None]  # head, body, tail; no tail: no sure place in the chunk


class _State(dict):
    """Character -> (next state, change of the token count); missing entries are compiled."""

    __slots__ = ("key", "owner")

    def __init__(self, key: tuple, owner: Transducer):
        super().__init__()
        self.key, self.owner = key, owner

    def __missing__(self, ch: str):
        key, change = self.owner.step(self.key, ch)
        found = self[ch] = (self.owner.state(key), change)
        return found


class _Units(dict):
    """Unit -> tokens, the compiled path of a unit as one transition; a unit begins at a sure place, so in the initial state."""

    def __init__(self, owner: Transducer):
        super().__init__()
        self.owner = owner

    def __missing__(self, text: str) -> int:
        found = self.owner.walk(text)
        if len(text) <= 40:  # longer ones seldom come again
            self[text] = found
        return found


class Transducer:
    """The compiled form of a tokenizer file: byte-level BPE with the usual cut into pieces.

    Raises ValueError for a file of another kind.
    """

    def __init__(self, tokenizer_file: str, most_states: int = MOST_STATES):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        said = json.loads(tokenizer.to_str())
        model, added = said["model"], said["added_tokens"]
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)
        odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")]
        if said["normalizer"] or said["pre_tokenizer"] != PRE_TOKENIZER or model["type"] != "BPE" or any(odd) or not plain:
            raise ValueError("the tokenizer file is not a plain byte-level BPE")
        self.model, self.cut = tokenizer.model, tokenizer.pre_tokenizer.pre_tokenize_str
        self.specials = sorted((t["content"] for t in added), key=len, reverse=True)
        self.written = {i: w for w, i in model["vocab"].items()}
        self._grow({w: i for w, i in model["vocab"].items() if w not in self.specials})
        self.most_states, self.classes = most_states, {}
        self.states: dict[tuple, _State] = {}
        self.stay: dict[int, bool] = {}
        self.begin = self.state(("B",))
        self.units = _Units(self)
        self.unit = re.compile(f"[{WHITE}]+[^{WHITE}]*|[^{WHITE}]+").findall

    def state(self, key: tuple) -> _State:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = _State(key, self)
        return found

    def trim(self) -> None:
        """Start the table afresh once it is full; called between texts."""
        if len(self.states) > self.most_states:
            for state in self.states.values():
                state.clear()  # no cycles are left to collect
            self.states = {}
            self.begin = self.state(("B",))
        if len(self.stay) > 2 * self.most_states:
            self.stay = {}
        if len(self.units) > 2 * self.most_states:
            self.units.clear()

    def kind(self, ch: str) -> str:
        """L letter, N digit, O other sign, S white space."""
        found = self.classes.get(ch)
        if found is None:
            found = "L" if len(self.cut("a" + ch)) == 1 else "N" if len(self.cut("1" + ch)) == 1 else "O" if len(self.cut("!" + ch)) == 1 else "S"
            self.classes[ch] = found
        return found

    def _grow(self, vocab: dict[str, int]) -> None:
        """The tree of all tokens: per node its children by byte, its token (or -1) and, if few, the tokens below."""
        byte_of = {letter: byte for byte, letter in _byte_letters().items()}
        self.children: list[dict[int, int]] = [{}]
        self.token = [-1]
        for word, token in vocab.items():
            node = 0
            for letter in word:
                below = self.children[node]
                node = below.setdefault(byte_of[letter], len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    self.token.append(-1)
            self.token[node] = token
        self.below: list[tuple[int, ...] | None] = [None] * len(self.token)
        for node in range(len(self.token) - 1, -1, -1):  # children come after their parents
            held: list[int] = []
            for child in self.children[node].values():
                deeper = self.below[child]
                if deeper is None:
                    break
                held += [self.token[child]] * (self.token[child] >= 0) + list(deeper)
            else:
                if len(held) <= FEW:
                    self.below[node] = tuple(held)

    def both_stay(self, a: int, b: int) -> bool:
        """Whether BPE leaves these two tokens as they are when they stand alone; -1 before the start of a piece."""
        if a < 0:
            return True
        key = a << 20 | b
        found = self.stay.get(key)
        if found is None:
            found = self.stay[key] = [t.id for t in self.model.tokenize(self.written[a] + self.written[b])] == [a, b]
        return found

    def feed(self, piece: tuple, ch: str) -> tuple[tuple, int]:
        """(piece state, change) after one more character of a piece.

        A piece state lists, longest first, for each place that still matters:
        the node of the tree that the bytes since then lead to, the token before
        the place (-1 at the start of the piece) and the tokens up to it, counted
        against now.  A place matters while a longer token from there would stay
        beside the token before it.
        """
        change, children, token_at, below, stays = 0, self.children, self.token, self.below, self.both_stay
        for byte in ch.encode("utf-8"):
            grown, last, now = [], -1, 0
            for i in range(0, len(piece), 3):
                node = children[piece[i]].get(byte)
                if node is not None:
                    before, count, token, few = piece[i + 1], piece[i + 2], token_at[node], below[node]
                    if last < 0 <= token and stays(before, token):
                        last, now = token, count + 1
                    if few is None or any(stays(before, t) for t in few):
                        grown.append((node, before, count))
            change += now
            flat = []
            for node, before, count in grown:
                flat += (node, before, count - now)
            piece = (*flat, 0, last, 0)
        return piece, change

    EMPTY = (0, -1, 0)

    def first(self, ch: str) -> tuple[tuple, int]:
        """The step of a character that begins a piece."""
        kind = self.kind(ch)
        piece, change = self.feed(self.EMPTY, ch)
        if kind == "S":
            return ("W", ch, ()), change
        return (("A",) if ch == "'" else ("X", kind, *piece)), change

    def counted(self, text: str) -> int:
        piece, total = self.EMPTY, 0
        for ch in text:
            piece, change = self.feed(piece, ch)
            total += change
        return total

    def step(self, key: tuple, ch: str) -> tuple[tuple, int]:
        """The next state's key and the change of the token count."""
        kind, mode = self.kind(ch), key[0]
        if mode == "X" and kind == key[1]:
            piece, change = self.feed(key[2:], ch)
            return ("X", kind, *piece), change
        if mode == "A" and kind == "O":
            piece, change = self.feed(self.feed(self.EMPTY, "'")[0], ch)
            return ("X", "O", *piece), change
        if mode == "A" and "'" + ch in CONTRACTIONS:
            return ("B",), self.counted("'" + ch) - self.counted("'")
        if mode == "A" and any(c.startswith("'" + ch) for c in CONTRACTIONS):
            return ("R", ch), self.counted(ch)
        if mode == "R" and "'" + key[1] + ch in CONTRACTIONS:
            return ("B",), self.counted("'" + key[1] + ch) - self.counted("'") - self.counted(key[1])
        if mode == "R" and kind == "L":
            piece, change = self.feed(self.feed(self.EMPTY, key[1])[0], ch)
            return ("X", "L", *piece), change
        if mode == "W":
            pending, run = key[1], key[2]
            alone, own = self.feed(self.EMPTY, pending)
            if kind == "S":
                run = self.feed(run or self.EMPTY, pending)[0]
                return ("W", ch, run), self.feed(run, ch)[1]
            parted = own - self.feed(run, pending)[1] if run else 0  # the last white space leaves the run
            if pending == " ":
                piece, change = self.feed(alone, ch)
                return ("X", kind, *piece), parted + change
            key, change = self.first(ch)
            return key, parted + change
        return self.first(ch)

    def _segments(self, text: str) -> list[str]:
        """The text between special tokens, which cut it before all else; longer ones are looked for first."""
        parts = [text]
        for special in self.specials:
            if special in text:
                parts = [x for p in parts for x in p.split(special)]
        return parts

    def count(self, text: str) -> int:
        """The number of tokens of a whole text."""
        parts = self._segments(text) if self.specials else [text]
        return len(parts) - 1 + sum(sum(map(self.units.__getitem__, self.unit(part))) for part in parts)

    def walk(self, text: str) -> int:
        """The sum of the numbers along a text without special tokens, from the initial state."""
        state, total = self.begin, 0
        for ch in text:
            state, change = state[ch]
            total += change
        return total

    def sure(self, before: str, ch: str) -> bool:
        """Whether, between these two characters, every state goes on as the initial one does."""
        a, b = self.kind(before), self.kind(ch)
        return a != "S" and a != b and (b in "SN" or a in "LN" or before != "'")

    def chunk_map(self, chunk: str) -> Map:
        """The state map of a chunk whose ends cut no special token; the place before such a token is sure."""
        found = [(at, at + len(s)) for s in self.specials for at in _places(chunk, s)]
        first, last = (min(found)[0], max(found)) if found else (len(chunk), (None, 0))
        low = next((i for i in range(1, first) if self.sure(chunk[i - 1], chunk[i])), first if found else None)
        if low is None:
            return chunk, 0, None
        high = next((i for i in range(len(chunk) - 1, last[1], -1) if self.sure(chunk[i - 1], chunk[i])), last[0])
        return chunk[:low], self.count(chunk[low:high]), chunk[high:]

    def compose(self, a: Map, b: Map) -> Map:
        """The map of two chunks in a row; associative."""
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        if b[2] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.count(a[2] + b[0]) + b[1], b[2]

    def total(self, whole: Map) -> int:
        """The tokens of a text whose chunks compose to this map."""
        return self.count(whole[0]) + whole[1] + (self.count(whole[2]) if whole[2] is not None else 0)

    def scan(self, maps: list[Map]) -> list[Map]:
        """Inclusive prefix compositions in log2(n) rounds; the maps of one round do not depend on each other."""
        maps, reach = list(maps), 1
        while reach < len(maps):
            maps = maps[:reach] + [self.compose(a, b) for a, b in zip(maps, maps[reach:])]
            reach *= 2
        return maps

    def fold(self, maps: list[Map]) -> Map:
        """All maps composed, pair by pair in log2(n) rounds (the last entry of ``scan`` with n - 1 compositions)."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0] if maps else ("", 0, None)

    def chunks(self, text: str, size: int) -> Iterator[str]:
        """Chunks of about ``size`` characters; a special token stays in one of them."""
        low, longest = 0, max(map(len, self.specials), default=1)
        while low < len(text):
            high = min(low + size, len(text))
            for special in self.specials:
                at = text.find(special, max(low, high - longest + 1), high + longest - 1)
                if at >= 0 and at < high < at + len(special):
                    high = at if at > low else at + len(special)
            yield text[low:high]
            low = high


def _places(text: str, part: str) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + len(part))


_compiled: dict[str, Transducer] = {}


def transducer(tokenizer_file: str) -> Transducer:
    """One transducer per Python worker, kept from task to task."""
    if tokenizer_file not in _compiled:
        _compiled[tokenizer_file] = Transducer(tokenizer_file)
    return _compiled[tokenizer_file]


def _tally(tokenizer_file: str, chunk_chars: int, span_chars: int):
    """Counts of texts up to a span; longer ones come out span by span, to be dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer_file)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            rows, tokens, keys, spans, pieces = [], [], [], [], []
            for i, text in enumerate(texts):
                text = text.as_py()
                machine.trim()
                if len(text) <= span_chars:
                    found = machine.count(text) if len(text) <= chunk_chars else machine.total(_folded(machine, text, chunk_chars))
                    cut, key = [None], None
                else:
                    cut, key, found = list(machine.chunks(text, span_chars)), uuid.uuid4().hex, None
                for n, piece in enumerate(cut):
                    rows.append(i)
                    tokens.append(found)
                    keys.append(key)
                    spans.append(None if key is None else n)
                    pieces.append(piece)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(at), batch.column("n_bytes").take(at), pa.array(tokens, pa.int64()), pa.array(keys, pa.string()), pa.array(spans, pa.int32()), pa.array(pieces, pa.string())],
                ["id", "n_bytes", "n_tokens", "row_key", "span", "piece"])

    return run


def _folded(machine: Transducer, text: str, chunk_chars: int) -> Map:
    maps = []
    for chunk in machine.chunks(text, chunk_chars):
        maps.append(machine.chunk_map(chunk))
        machine.trim()
    return machine.fold(maps)


def _span_maps(tokenizer_file: str, chunk_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer_file)
        for batch in batches:
            maps = [_folded(machine, piece.as_py(), chunk_chars) for piece in batch.column("piece")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key"), batch.column("id"), batch.column("n_bytes"), batch.column("span"), pa.array([m[0] for m in maps], pa.string()),
                 pa.array([m[1] for m in maps], pa.int64()), pa.array([m[2] for m in maps], pa.string())], ["row_key", "id", "n_bytes", "span", "head", "body", "tail"])

    return run


def _compose_spans(tokenizer_file: str):
    def run(table: pa.Table) -> pa.Table:
        machine = transducer(tokenizer_file)
        table = table.sort_by("span")
        whole = machine.fold(list(zip(table["head"].to_pylist(), table["body"].to_pylist(), table["tail"].to_pylist())))
        return table.slice(0, 1).select(["id", "n_bytes"]).append_column("n_tokens", pa.array([machine.total(whole)], pa.int64()))

    return run


def token_counts(
    docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, chunk_chars: int = 1 << 16, span_chars: int = 1 << 22,
) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)``, one row per row of ``docs``.

    ``n_tokens`` is what the tokenizers library gives for the whole text, without
    added tokens; a special token's string inside a text counts as that one
    token.  ``over_limit`` tells more than ``limit`` tokens.  Null counts as the
    empty text, which has 0 tokens.  Repeated rows and null ids each get their
    row.  Texts of up to ``span_chars`` characters are counted where they are
    read, without a shuffle, those beyond ``chunk_chars`` as composed chunk maps.
    Longer texts are dealt out span by span, and one row per text then composes
    their maps; a run without any sure place (one endless word) is counted in one
    task.  Only the two named columns are read, so others cannot clash; an empty
    table gives an empty result.  The counts go through the shared folder.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    ids = T.StructField("id", base.schema["id"].dataType)
    shape = T.StructType([ids, *T.DataType.fromDDL("n_bytes long, n_tokens long, row_key string, span int, piece string").fields])
    told = SharedStage(docs.sparkSession, "tally").put(base.mapInArrow(_tally(tokenizer_file, chunk_chars, span_chars), shape), "told")
    out = told.where("span IS NULL").select("id", "n_bytes", "n_tokens")
    long_ones = told.where("span IS NOT NULL").select("row_key", "id", "n_bytes", "span", "piece").repartition("row_key", "span")
    maps_shape = T.StructType([T.StructField("row_key", T.StringType()), ids, *T.DataType.fromDDL("n_bytes long, span int, head string, body long, tail string").fields])
    maps = long_ones.mapInArrow(_span_maps(tokenizer_file, chunk_chars), maps_shape)
    composed = maps.groupBy("row_key").applyInArrow(_compose_spans(tokenizer_file), T.StructType([ids, *T.DataType.fromDDL("n_bytes long, n_tokens long").fields]))
    return out.unionByName(composed).withColumn("over_limit", F.col("n_tokens") > limit)
