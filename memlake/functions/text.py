"""Scalar text functions as Column expressions (JVM side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of the keyword index.
STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can "
    "need dare ought used to of in for on with at by from as into through during before after above below between out "
    "off over under again further then once here there when where why how all each every both few more most other "
    "some such no nor not only own same so than too very and but or if while because until although this that these "
    "those it its i me my we our you your he him his she her they them their what which who whom").split()
#: Words that titles share too often to compare by.
TITLE_STOPWORDS = (
    "the and for you your with that this from are was were have has had will would could what when where which who how "
    "why but not all any some more less than into out about session turn user assistant").split()
#: Suffixes in the order tried.
SUFFIXES = ["ations", "ation", "ings", "ing", "ers", "er", "ors", "or", "ions", "ion", "ed", "es", "s"]
#: Words that make a query a question, and phrases that ask for what is new, was once, or holds now.
QUESTION_WORDS = ["what", "how", "why", "which", "where", "when", "who", "does", "is", "can"]
FRESH = (r"(?i)\b(recent|recently|latest|newest|current|currently|now|today|tonight|yesterday|just now|lately|updated|newly|most recent"
         r"|this (week|month|year|morning|afternoon|evening)|in the last \w+|for the last \w+)\b")
HISTORICAL = (r"(?i)\b(original|originally|first|initially|initial|used to|back then|back when|previously|formerly|historically|ancient|long ago"
              r"|in the past|at the start|at the beginning|early on|earlier|old(est|er)?|was (the|a|an|my|our|your)|were (the|a|my|our|your)|before (we|i|they|you))\b")
CURRENCY = r"(?i)\b(current|currently|latest|now|nowadays|these days|right now|at the moment|as of now)\b"
#: The ways a note states a standing preference.
PREFERENCE_MARKERS = [
    r"\bi (?:always|usually|generally|typically|normally|tend to|habitually)\b",
    r"\bi (?:prefer|favou?r|like|love|enjoy)\b",
    r"\bi (?:never|don'?t|do not|dislike|hate|avoid|can'?t stand)\b",
    r"\bi(?:'m| am) an? [a-z][a-z \-]{1,30}? (?:person|user|fan|type)\b",
    r"\b(?:my|our) (?:go-?to|default|preferred|favou?rite) \b",
    r"\bi (?:still )?(?:remember|recall)\b",
    r"\bgrowing up\b",
]
_VALUE = r"([a-z0-9£$€][a-z0-9£$€.%/ \-]{0,38}?)(?:\s+(?:after|this|next|going|starting|effective|from|for|since|because|so|but|and|then|now|as)\b|\s*$)"
#: The three ways a sentence revises a fact; group 1 subject, group 2 value.
FACT_PATTERNS = [
    r"(?i)(?:my|our)\s+([a-z0-9][a-z0-9 \-]{2,39}?)\s+(?:is|are|=)\s+(?:now|currently)\s+" + _VALUE,
    r"(?i)\b(?:bumped|raised|lowered|changed|set|moved|increased|decreased|updated|switched)\s+(?:my\s+|our\s+|the\s+)?([a-z0-9][a-z0-9 \-]{2,39}?)\s+to\s+" + _VALUE,
    r"(?i)\bupdate:?\s+([a-z0-9][a-z0-9 \-]{2,39}?)\s*(?:=|:|\bis\b)\s*" + _VALUE,
]
#: Secret and personal-data classes, by the pattern that finds them.
SECRET_PATTERNS = [
    ("pem_block", r"(?s)-----BEGIN [A-Z0-9 ]{1,64}-----.*?-----END [A-Z0-9 ]{1,64}-----"),
    ("bearer_token", r"(?i)\bauthorization\s*:\s*(?:bearer|token|basic)\s+([A-Za-z0-9._~+/=-]{8,})"),
    ("aws_access_key_id", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("api_token", r"\b(?:sk|pk|rk)-[A-Za-z0-9_-]{16,}\b"),
    ("api_token", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{16,}\b"),
    ("api_token", r"\bgithub_pat_[A-Za-z0-9_]{20,}\b"),
    ("api_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b"),
    ("key_value_secret", r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?token|client[_-]?secret)\b\s*[=:]\s*[\"']?([^\s\"',;]{6,})"),
    ("high_entropy", r"\b[A-Za-z0-9+/=_-]{32,}\b"),
]


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokenize(text: Column) -> Column:
    """keyword tokens, repeats kept; no stop words, none of one character.  Markup ends a token as any other sign does."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:-[a-z0-9]+)*"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS))


def light_stem(token: Column) -> Column:
    """cut the first suffix that fits, if more than two characters stay."""
    out = token
    for suffix in reversed(SUFFIXES):
        fits = token.endswith(suffix) & (F.octet_length(token) > len(suffix) + 2)
        out = F.when(fits, F.substring(token, F.lit(1), F.length(token) - len(suffix))).otherwise(out)
    return out


def split_sentences(text: Column) -> Column:
    """cut after . ! ? before space and a capital A-Z, and at line ends; trimmed, no empty ones."""
    parts = F.flatten(F.transform(F.split(text, r"(?<=[.!?])[ \t]+(?=[A-Z])"), lambda s: F.split(s, "\n")))
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def clause_sentences(text: Column, marks: str = ".!?;") -> Column:
    """Rough clauses for facts and preferences: cut at ``marks`` and line ends, leading markup dropped."""
    parts = F.split(text, r"[\n\r" + marks + "]")
    clean = F.transform(parts, lambda s: F.trim(F.regexp_replace(F.trim(s), r"^[#*\->` ]+", "")))
    return F.filter(clean, lambda s: s != "")


def extract_title(text: Column) -> Column:
    """the first level-one heading, or empty."""
    return F.trim(F.regexp_extract(text, r"(?m)^[ \t]*# (.*)$", 1))


def infer_kind(filename: Column) -> Column:
    """kind by prefix of the file name."""
    name = F.lower(F.element_at(F.split(filename, "/"), -1))
    out = F.lit("note")
    for prefix, kind in [("conv-", "clip"), ("clip-", "clip"), ("theme-", "theme"), ("question-", "question"), ("draft-", "draft"), ("quote-", "quote"), ("source-", "source")]:
        out = F.when(name.startswith(prefix), kind).otherwise(out)
    return out


def content_hash(text: Column) -> Column:
    """F7."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def typed_wikilinks(text: Column) -> Column:
    """F8: array of (target, type) of ``[[target|type]]``, lower case; type null if absent."""
    raw = F.regexp_extract_all(text, F.lit(r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]"), F.lit(0))
    made = F.transform(raw, lambda r: F.struct(
        F.lower(F.trim(F.regexp_extract(r, r"\[\[([^\]|]+)", 1))).alias("target"),
        F.nullif(F.lower(F.trim(F.regexp_extract(r, r"\|([^\]]+)\]\]", 1))), F.lit("")).alias("link_type")))
    return F.filter(made, lambda x: x["target"] != "")


def extract_salient(q: Column) -> Column:
    """struct of ``names``, ``phrases`` and ``numerals`` of a query, each lower case, sorted, without repeats.

    A name is a capitalised word of three letters or more that opens no
    sentence, or a word with a capital inside; a phrase stands in double quotes,
    or in single ones if it has a space; a numeral has up to four digits.
    """
    q = F.coalesce(q, F.lit(""))
    tidy = lambda found: F.transform(found, lambda t: F.lower(F.trim(t)))
    double = F.filter(tidy(F.regexp_extract_all(q, F.lit(r'"([^"]{2,60})"'), F.lit(1))), lambda t: t != "")
    single = F.filter(tidy(F.regexp_extract_all(q, F.lit(r"'([^']{2,60})'"), F.lit(1))), lambda t: F.contains(t, F.lit(" ")))
    bare = lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    raw = F.filter(F.split(q, r"\s+"), lambda t: (bare(t) != "") | t.rlike(r"[.?!]$"))
    opens = F.transform(raw, lambda t, i: (i == 0) | F.coalesce(F.get(raw, i - 1).rlike(r"[.?!]$"), F.lit(False)))
    words = F.arrays_zip(F.transform(raw, bare).alias("word"), opens.alias("opens"))
    inside, capital = lambda w: w["word"].rlike(r"^\p{L}*\p{Ll}\p{Lu}\p{L}*$"), lambda w: w["word"].rlike(r"^\p{Lu}\p{Ll}{2,}$") & ~w["opens"]
    names = F.transform(F.filter(words, lambda w: inside(w) | capital(w)), lambda w: F.lower(w["word"]))
    names = F.filter(names, lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS))
    numerals = F.regexp_extract_all(q, F.lit(r"\b\d{1,4}\b"), F.lit(0))
    done = lambda a: F.array_sort(F.array_distinct(a))
    return F.struct(done(names).alias("names"), done(F.concat(double, single)).alias("phrases"), done(numerals).alias("numerals"))


def ce_probability(logit: Column) -> Column:
    """the logistic of a re-ranker's score."""
    return 1.0 / (1.0 + F.exp(-logit))


def classify_query(q: Column) -> Column:
    """F16: keyword, natural or mixed."""
    words = F.filter(F.split(q, r"\s+"), lambda w: w != "")
    asks = F.arrays_overlap(F.transform(F.slice(words, 1, 3), lambda w: F.lower(w)), strings(QUESTION_WORDS))
    asks = F.coalesce(asks, F.lit(False))
    return F.when((F.size(words) <= 4) & ~asks, "keyword").when(asks & (F.size(words) > 6), "natural").otherwise("mixed")


def temporal_intent(q: Column) -> Column:
    """fresh, historical, or neutral when both or neither is asked."""
    fresh, old = q.rlike(FRESH), q.rlike(HISTORICAL)
    return F.when(fresh & ~old, "fresh").when(old & ~fresh, "historical").otherwise("neutral")


def structural_confidence(kind: Column) -> Column:
    """F19."""
    return (F.when(kind.isin("source", "code"), 1.0).when(kind.isin("decision", "insight", "note"), 0.9)
            .when(kind == "preference", 0.85).when(kind == "observation", 0.6).otherwise(0.8))


def strip_private(text: Column) -> Column:
    """closed private blocks become a placeholder."""
    return F.regexp_replace(text, r"(?is)<private>.*?</private>", "[private content removed]")


def sanitize(text: Column, limit: int) -> Column:
    """F31."""
    return F.left(F.translate(F.trim(F.regexp_replace(text, r"\s+", " ")), "<>", "()"), F.lit(limit))


def estimate_tokens(text: Column) -> Column:
    """F32: characters / 4."""
    return F.floor(F.length(text) / 4)


def shannon_entropy(text: Column) -> Column:
    """bits per character; characters beyond ASCII count as one symbol."""
    chars = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(F.ascii(c) < 128, c).otherwise(F.lit("wide")))
    n = F.size(chars)
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
    return F.when(n == 0, 0.0).otherwise(F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p)))


def looks_high_entropy(token: Column, bits: float = 3.5) -> Column:
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    return mixed & ((shannon_entropy(token) >= bits) | token.rlike("^[0-9a-fA-F]{32,}$"))


def title_tokens(title: Column) -> Column:
    """distinct lower-case words of a title, 3 bytes or more, no stop words."""
    words = F.split(F.lower(title), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) >= 3) & ~w.isin(TITLE_STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def letter_grade(pct: Column) -> Column:
    """F38."""
    out = F.lit("F")
    for least, grade in [(60, "D"), (67, "D+"), (70, "C-"), (73, "C"), (77, "C+"), (80, "B-"), (83, "B"), (87, "B+"), (90, "A-"), (93, "A"), (97, "A+")]:
        out = F.when(pct >= least, grade).otherwise(out)
    return out


def age_days(then: Column, now: Column) -> Column:
    """days, never below 0, 0 if unknown."""
    return F.coalesce(F.greatest((F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400.0, F.lit(0.0)), F.lit(0.0))


def half_life_days(kind: Column) -> Column:
    """Recency half-life by kind."""
    return (F.when(kind == "working_state", 2.0).when(kind.isin("task", "todo"), 14.0).when(kind == "decision", 180.0)
            .when(kind.isin("preference", "playbook_rule", "source", "code"), 365.0).otherwise(90.0))


def salience(age: Column, kind: Column, uses: Column, importance: Column, confidence: Column, reliability: Column, links: Column) -> Column:
    """weighted salience; ``links`` counts the three kinds of active links."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    recency = unit(F.exp(-F.greatest(age, F.lit(0.0)) / half_life_days(kind) * F.log(F.lit(2.0))))
    usage = unit(F.log(1.0 + uses) / F.log(F.lit(20.0)))
    weight = F.when(importance == "high", 1.0).when(importance == "low", 0.3).otherwise(0.6)
    return 0.25 * recency + 0.20 * usage + 0.20 * weight + 0.15 * unit(confidence) + 0.10 * unit(reliability) + 0.10 * unit(links / 3.0)


def should_archive(score: Column, age: Column, uses: Column, importance: Column) -> Column:
    """F36."""
    return (score < 0.15) & (age > 90) & (uses == 0) & (importance == "low")


#: Intents with their confidence and phrases, in the order tried.
INTENTS = [
    ("continue_work", 1.0, ["continue", "what was i doing", "what was i working on", "pick up where", "where were we", "where did we leave off", "resume", "keep going"]),
    ("explain_decision", 0.9, ["why did we", "why did i", "what was the rationale", "what was the reasoning", "who decided", "why was it decided", "why do we use", "what led to the decision"]),
    ("find_source", 0.9, ["where did this number", "where did that number", "number come from", "figure come from", "percent come from", "where is this from", "what's the source",
                          "whats the source", "where does this come from", "where did this come from", "what source", "which source", "show me the evidence", "show the evidence",
                          "what supports this", "citation for", "cite the source"]),
    ("temporal_diff", 0.9, ["what changed since", "what has changed", "what changed", "what's new since", "whats new since", "what is new this week", "since yesterday", "since last week",
                            "since the last meeting", "since our last", "what did i miss", "did i miss anything", "while i was away", "since i last", "since last time", "what's new in", "whats new in"]),
    ("prepare_brief", 0.85, ["prepare me for", "prep me for", "brief me", "briefing for", "steering committee brief", "before the meeting", "before tomorrow's meeting",
                             "summarize what matters", "get me up to speed", "catch me up on"]),
    ("review_risks", 0.85, ["what are the risks", "what could go wrong", "review this for weak", "weak claims", "poke holes", "risk review", "what are we missing", "devil's advocate"]),
    ("draft_output", 0.75, ["draft the", "draft a", "draft an", "write the email", "write an email", "write the proposal", "write the summary", "compose the",
                            "create the executive summary", "write the follow-up", "draft the follow-up"]),
]


def route_intent(prompt: Column, fresh_state: Column) -> Column:
    """the first intent with a phrase in the prompt; single words must stand alone; continuing needs fresh state."""
    lower = F.lower(F.trim(prompt))
    out = F.lit("general_question")
    for intent, _, phrases in reversed(INTENTS):
        loose = "|".join(p for p in phrases if " " in p)
        alone = "|".join(p for p in phrases if " " not in p)
        if intent != "continue_work":
            out = F.when(lower.rlike(loose), intent).otherwise(out)
            continue
        # A single word inside another one is a hit only without fresh state, which then falls back.
        hit = lower.rlike(f"{loose}|{alone}")
        stands = lower.rlike(rf"{loose}|(?<![\p{{L}}\p{{N}}])(?:{alone})(?![\p{{L}}\p{{N}}])")
        out = F.when(hit & ~fresh_state, "general_question").when(stands & fresh_state, intent).otherwise(out)
    return out


def _cut_at_word(s: Column, limit: int) -> Column:
    cut = F.left(s, F.lit(limit))
    kept = F.when(F.instr(cut, " ") > 0, F.regexp_replace(cut, r"(?s) [^ ]*\z", "")).otherwise(cut)
    return F.when(F.length(s) <= limit, F.trim(s)).otherwise(F.trim(F.concat(F.regexp_replace(kept, r"[,;:]+\z", ""), F.lit("…"))))


#: Markup taken off before a summary, in this order, and what takes its place.
CHROME = [
    (r"(?s)\A---\n.*?\n---\n", ""), (r"(?s)```.*?```|`[^`]*`", " "), (r"(?m)^\s*(?:#\w+\s*)+$", ""), (r"(?m)^\s{0,3}#{1,6}\s+", ""),
    (r"\[\[[^\]|]+\|([^\]]+)\]\]", "$1"), (r"\[\[([^\]|]+)\]\]", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"),
    (r"(?m)^\s*>\s?", ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")]


def plain_text(content: Column) -> Column:
    """a note without its markup."""
    out = F.coalesce(content, F.lit(""))
    for pattern, instead in CHROME:
        out = F.regexp_replace(out, pattern, instead)
    return F.regexp_replace(out, r"\A\s+|\s+\z", "")


def summary_paragraph(plain: Column, limit: int = 480) -> Column:
    """the first paragraph of 40 characters or with an end mark, else the first two joined."""
    paras = F.filter(F.transform(F.split(plain, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"\A\s+|\s+\z", "")), lambda p: p != "")
    told = F.filter(paras, lambda p: (F.length(p) >= 40) | p.rlike("[.!?]"))
    return _cut_at_word(F.coalesce(F.try_element_at(told, F.lit(1)), F.array_join(F.slice(paras, 1, 2), " ")), limit)


def summary_sentence(plain: Column, title: Column, limit: int = 180) -> Column:
    """the first sentence, abbreviations aside, led by the title unless it starts with it."""
    flat = F.trim(F.regexp_replace(plain, r"\s+", " "))
    # Each abbreviation's points become a sign of the same length, so positions hold.
    masked = F.regexp_replace(F.left(flat, F.lit(limit + 80)), r"\b(e|i)\.(g|e)\.", "$1\u0001$2\u0001")
    masked = F.regexp_replace(masked, r"\b(etc|vs|Mr|Mrs|Dr|No)\.", "$1\u0001")
    end = F.length(F.regexp_extract(masked, r"(?s)\A(.*?[.!?])\s+[A-Z]", 1))
    one = F.when(end > 0, F.trim(F.left(flat, end))).otherwise(_cut_at_word(flat, limit))
    name = F.regexp_replace(F.trim(F.coalesce(title, F.lit(""))), r"\.+\z", "")
    led = F.contains(F.lower(F.left(one, F.length(name) + 2)), F.lower(name))
    return F.when(flat == "", "").when((name == "") | led, one).otherwise(_cut_at_word(F.concat(name, F.lit(" — "), one), limit + 80))


def resolve_anchor(prompt: Column, now: Column, last_seen: Column) -> Column:
    """(anchor, start) of the time that a prompt asks about."""
    q = F.lower(F.coalesce(prompt, F.lit("")))
    date = F.try_to_timestamp(F.regexp_extract(q, r"since (2\d{3}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd"))
    midnight = F.date_trunc("day", now)
    ago = lambda hours: F.timestamp_seconds(F.unix_timestamp(now) - hours * 3600)
    made = lambda name, start: F.struct(F.lit(name).alias("anchor"), start.alias("start"))
    missed = q.rlike("did i miss|since last time|since i last|last worked on|since my last|since our last|while i was away")
    return (F.when(date.isNotNull(), made("explicit_date", date))
            .when(q.contains("yesterday"), made("yesterday", F.timestamp_seconds(F.unix_timestamp(midnight) - 86400)))
            .when(q.contains("today"), made("today", midnight)).when(q.contains("this week"), made("this_week", F.date_trunc("week", now)))
            .when(missed & last_seen.isNotNull(), made("since_last_session", last_seen)).when(missed, made("fallback", ago(24)))
            .when(q.rlike("last 24|24 hours|24h"), made("last_24h", ago(24))).otherwise(made("fallback", ago(24))))


def normalize_room(raw: Column) -> Column:
    """F39."""
    return F.regexp_replace(F.trim(raw), r"\A/+|/+\z", "")


def folder_of(filename: Column) -> Column:
    """the first folder of a path, or empty."""
    return F.regexp_extract(filename, r"\A([^/]+)/", 1)
