"""Signals of a prompt and the reasons of a hit, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of four letters or more that say nothing about a prompt's subject.
FILLER = (
    "this that these those then than there here where when what which with without will would should could shall must have having been being were your yours mine ours "
    "them they their theirs some same such just very much more most many each every also into onto from over under about after before again still only even ever never "
    "always once make makes made making sure work works worked working well good great nice okay continue continues continued keep keeps going lets please thanks thank "
    "want wants wanted need needs needed like liked look looks looked looking check checks checked take takes taken give gives given help helps done doing know knows "
    "think thinks thing things stuff ways come comes came start starts started finish finished right wrong yeah back next last first second time times later soon little "
    "really actually maybe probably possibly everything something anything nothing someone anyone everyone").split()
#: File endings that make a path of a bare name, and signs of an error.
EXTENSIONS = "rs|ts|tsx|js|jsx|py|md|json|toml|yaml|yml|sh|sql|css|html|go|java|c|h|cpp|swift"
FILE_PATH = rf"[/\\][^/\\]*\.[^/\\]*[^/\\.]\z|\A[^/\\]+\.(?:{EXTENSIONS})\z"
CODE_SYMBOL = r"::|\(\)\z|\A.+_.+\z|\A[a-z].*[A-Z]"
ERROR_SIGNS = "error|panic|exception|traceback|failed with"


def raw_tokens(prompt: Column) -> Column:
    """Words without the marks around them."""
    return F.filter(F.transform(F.split(prompt, r"\s+"), lambda t: F.regexp_replace(t, r"\A[,;:?!)(\"']+|[,;:?!)(\"']+\z", "")), lambda t: t != "")


def file_paths(prompt: Column) -> Column:
    """the file paths of a prompt, lower case."""
    return F.transform(F.filter(raw_tokens(prompt), lambda t: t.rlike(FILE_PATH)), lambda t: F.lower(t))


def code_symbols(prompt: Column) -> Column:
    """the code symbols of a prompt that are no paths, lower case."""
    found = F.filter(raw_tokens(prompt), lambda t: ~t.rlike(FILE_PATH) & (F.octet_length(t) >= 3) & t.rlike(CODE_SYMBOL))
    return F.transform(found, lambda t: F.lower(F.regexp_replace(t, r"(?:\(\))+\z", "")))


def contentful_tokens(prompt: Column) -> Column:
    """words of four characters or more without filler, repeats kept."""
    return F.filter(F.split(F.lower(prompt), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= 4) & ~w.isin(FILLER))


def repo_terms(repo: Column, branch: Column) -> Column:
    """the name of a repository and the longer parts of its branch, lower case."""
    name = F.filter(F.array(F.lower(F.coalesce(repo, F.lit("")))), lambda t: F.octet_length(t) >= 3)
    return F.concat(name, F.filter(F.split(F.lower(F.coalesce(branch, F.lit(""))), "[/_-]"), lambda t: F.octet_length(t) >= 4))


def prompt_quality(prompt: Column, repo: Column | None = None, branch: Column | None = None) -> Column:
    """struct of (contentful, vague, signals); a null prompt is vague."""
    known = F.coalesce(prompt, F.lit(""))
    none = F.lit(None).cast("string")
    named = F.exists(repo_terms(none if repo is None else repo, none if branch is None else branch), lambda t: F.contains(F.lower(known), t))
    tests = [("file_path", F.size(file_paths(known)) > 0), ("code_symbol", F.size(code_symbols(known)) > 0), ("error_string", F.lower(known).rlike(ERROR_SIGNS)), ("repo_term", named)]
    signals = F.array_compact(F.array(*[F.when(test, name) for name, test in tests]))
    n = F.size(contentful_tokens(known))
    return F.struct(n.alias("contentful"), ((n < 2) & (F.size(signals) == 0)).alias("vague"), signals.alias("signals"))


def explain_hit(semantic_rank: Column, semantic_sim: Column, keyword_rank: Column, graph_rank: Column, ce_prob: Column, via_spread: Column) -> Column:
    """why a row was found, in words; every part may be null."""
    rank = lambda r: F.concat(F.lit("(rank "), r.cast("string"), F.lit(")"))
    parts = F.array_compact(F.array(
        F.when(semantic_rank.isNotNull(), F.concat(F.lit("semantic match "), F.when(semantic_sim.isNotNull(), F.format_string("%.2f ", semantic_sim)).otherwise(""), rank(semantic_rank))),
        F.concat(F.lit("keyword match "), rank(keyword_rank)), F.concat(F.lit("entity-graph link "), rank(graph_rank))))
    tail = F.when(ce_prob.isNotNull(), F.format_string("; reranked %.2f", ce_prob)).otherwise("")
    return (F.when(F.size(parts) > 0, F.concat(F.array_join(parts, " + "), tail)).when(F.coalesce(via_spread, F.lit(False)), "linked neighbour (spreading activation)")
            .otherwise(F.concat(F.lit("fused candidate"), tail)))
