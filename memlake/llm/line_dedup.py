"""Line dedup by a log-template tree (operator 10, native).

Each line is parsed along a tree of fixed depth: its token count, then its
leading tokens, where tokens with a digit stand as ``<*>`` (a line that is mostly
such tokens has no wording to go by and stands for itself).  Two rounds give
templates:

* the line with its digit tokens generalised, and
* inside a leaf, for lines not settled so far: a token is constant where
  ``min_docs`` lines of the leaf have it at its position, other tokens are
  variable fields; at least ``least_constant`` of a template's tokens must be
  constant.

A template that recurs in ``min_docs`` different texts goes, with all its lines.
A long one (``long_tokens`` tokens, or six characters for each of as many) goes
from two different texts on, and its tokens are constant where two lines of the
leaf have them, too.  A short line's leaf has its first ``depth`` tokens; a long
line is in two leaves, one by the first quarter of its tokens and one by the
last.  So the leaves of long lines hold variants of one wording at any corpus
size: with two leading tokens they fill up with lines that meet by chance, whose
tokens then look constant and hide the variants.

All depends on the text alone, so texts are known by two 64-bit hashes.  Lines
are told apart by two hashes of 63 and 64 bits; the lowest bit of the first
tells the long ones.  Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.plans.names import free_names
from memlake.plans.shared import SharedStage

SPACES = r"[\x20\x09-\x0D]+"


def _tokens(line: Column) -> Column:
    """Tokens of a line, those with a digit generalised, unless they are more than half of it."""
    raw = F.filter(F.split(line, SPACES), lambda t: t != "")
    loose = F.filter(F.split(F.regexp_replace(line, r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", "<*>"), SPACES), lambda t: t != "")
    fixed = F.size(F.filter(loose, lambda t: t != "<*>"))
    return F.when(line.rlike("[0-9]"), F.when(2 * fixed >= F.size(loose), loose).otherwise(raw)).otherwise(raw)


def _flagged(hashed: Column, flag: Column) -> Column:
    """``hashed`` with ``flag`` as its lowest bit."""
    return hashed.bitwiseAND(F.lit(-2)).bitwiseOR(flag.cast("long"))


def _is_long(flagged: str) -> Column:
    return F.col(flagged).bitwiseAND(F.lit(1)) == 1


def _recurring(lines: DataFrame, keys: list[str], min_docs: int) -> DataFrame:
    """The keys that ``min_docs`` different texts have, or two if the first key tells a long line; equal texts count once."""
    counts = lines.select(*keys, "t1").distinct().groupBy(*keys).count()
    return counts.where(F.col("count") >= F.when(_is_long(keys[0]), min(2, min_docs)).otherwise(min_docs)).select(*keys)


def drop_recurring_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 5, depth: int = 2, least_constant: float = 0.7,
    lines_col: str = "n_lines", dropped_col: str = "n_dropped", long_tokens: int = 20,
) -> DataFrame:
    """``docs`` with recurring lines gone from ``text_col``, and the counts of lines and of dropped lines.

    Lines end at ``\\n``; blank lines have no template and stay, in place.  A
    null text stays null with no lines, an empty one stays empty.  Long
    templates recur from two texts on, short ones from ``min_docs``, a fixed
    number whatever the corpus size.  Equal texts count as one document, so
    plain copies do not make their lines recur, and all of them lose the same
    lines; rows repeated in id and text are treated alike, null ids as any
    other.  All columns pass through, in their order (counts are replaced if
    there); no name of an input column is taken.  ``id_col`` is not looked at: a
    line's fate depends on texts alone.  A text of any length is cut into lines
    once per round; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    stage = SharedStage(spark, "lines")
    docs = docs.drop(lines_col, dropped_col)
    t1, t2, lost, parts = free_names(docs, "__t1", "__t2", "__lost", "__parts")
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    known = [F.xxhash64(body), F.xxhash64(F.lit(7), body)]
    # Hashes and lines first: an explode copies what stands beside it to each of its rows.
    cut = docs.select(known[0].alias("t1"), known[1].alias("t2"), F.split(body, "\n").alias("cut")).select("t1", "t2", F.posexplode("cut").alias("pos", "line"))
    parsed = cut.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("tokens", _tokens(F.col("line")))
    flat, n = F.array_join("tokens", " "), F.size("tokens")
    many = n >= long_tokens
    lead = F.when(many, F.floor(n / 4)).otherwise(F.lit(depth)).cast("int")
    front = _flagged(F.xxhash64(n, F.slice("tokens", F.lit(1), lead)), many)
    back = F.when(many, _flagged(F.xxhash64(F.lit(1), n, F.slice("tokens", n - lead + 1, lead)), many))
    line = _flagged(F.xxhash64(flat), many | (F.length(flat) >= 6 * long_tokens))
    lines = stage.put(parsed.select("t1", "t2", "pos", line.alias("a"), F.xxhash64(F.lit(1), flat).alias("b"), front.alias("front"), back.alias("back")), "lines")
    whole = _recurring(lines, ["a", "b"], min_docs).withColumn("settled", F.lit(True))
    told = stage.put(lines.join(whole, ["a", "b"], "left").select("t1", "t2", "pos", "front", "back", "settled"), "told")
    stage.drop(lines)
    gone = told.where("settled").select("t1", "t2", "pos")
    # Second round: lines not settled, in leaves that enough different texts share.
    rest = told.where("settled IS NULL").select("t1", "t2", "pos", F.explode(F.array_compact(F.array("front", "back"))).alias("leaf"))
    open_lines = rest.join(_recurring(rest, ["leaf"], min_docs), "leaf")
    asked = open_lines.groupBy("t1", "t2").agg(F.collect_set(F.struct("pos", "leaf")).alias("asked"))
    picked = F.transform("asked", lambda p: F.struct(p["pos"].alias("pos"), p["leaf"].alias("leaf"), F.element_at("cut", p["pos"] + 1).alias("line")))
    again = (
        docs.select(known[0].alias("t1"), known[1].alias("t2"), body.alias("body")).join(asked, ["t1", "t2"])
        .withColumn("cut", F.split("body", "\n")).select("t1", "t2", picked.alias("picked")).select("t1", "t2", F.explode("picked").alias("p"))
        .select("t1", "t2", "p.pos", "p.leaf", _tokens(F.col("p.line")).alias("tokens")))
    # Equal texts give equal rows: one of them counts.
    fields = stage.put(again.select("t1", "t2", "pos", "leaf", F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens")).distinct(), "fields")
    each = fields.select("t1", "t2", "pos", "leaf", F.posexplode("tokens").alias("i", "token"))
    # Constant (2) for all lines, (1) for long ones only.
    constant = (
        each.groupBy("leaf", "i", "token").count().where((F.col("count") >= min_docs) | _is_long("leaf") & (F.col("count") >= 2))
        .select("leaf", "i", "token", F.when(F.col("count") >= min_docs, 2).otherwise(1).alias("fixed")))

    def shape(least: int) -> list[Column]:
        held = F.coalesce(F.col("fixed") >= least, F.lit(False))
        return [
            F.sum(F.when(held, F.xxhash64("i", "token")).otherwise(F.xxhash64("i")).cast("decimal(38,0)")).alias(f"sum{least}"),
            F.sum(F.when(held, F.xxhash64(F.lit(1), "i", "token")).otherwise(F.xxhash64(F.lit(1), "i")).cast("decimal(38,0)")).alias(f"other{least}"),
            F.avg(held.cast("int")).alias(f"share{least}")]

    shapes = F.array(*[F.struct(F.col(f"sum{x}").alias("sum"), F.col(f"other{x}").alias("sum2"), F.col(f"share{x}").alias("share"), F.lit(x).alias("least")) for x in (2, 1)])
    shaped = (
        each.join(constant, ["leaf", "i", "token"], "left")
        .groupBy("t1", "t2", "pos", "leaf").agg(*shape(2), *shape(1))
        .select("t1", "t2", "pos", "leaf", F.explode(shapes).alias("t"))
        .where((F.col("t.share") >= least_constant) & ((F.col("t.least") == 2) | _is_long("leaf")))
        .select("t1", "t2", "pos", "leaf", F.xxhash64("t.sum", "t.sum2").alias("shape"), F.xxhash64(F.lit(1), "t.sum", "t.sum2").alias("shape2")))
    shaped = stage.put(shaped, "shaped")
    stage.drop(fields)
    loose = shaped.join(_recurring(shaped, ["leaf", "shape", "shape2"], min_docs), ["leaf", "shape", "shape2"]).select("t1", "t2", "pos")
    drops = gone.unionByName(loose).groupBy(F.col("t1").alias(t1), F.col("t2").alias(t2)).agg(F.collect_set("pos").alias(lost))
    text = F.col(text_col).cast("string")
    joined = docs.withColumns({t1: known[0], t2: known[1]}).join(drops, [t1, t2], "left").withColumn(parts, F.split(text, "\n"))
    kept = F.when(F.col(lost).isNull(), text).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(lost, i)), "\n"))
    return joined.select(
        *[kept.alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.when(text.isNull(), 0).otherwise(F.size(parts)).cast("long").alias(lines_col),
        F.when(F.col(lost).isNull(), 0).otherwise(F.size(lost)).cast("long").alias(dropped_col))
