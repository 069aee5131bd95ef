"""Transcript text rules as column expressions (all JVM-side)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialoom.functions import fixed

NON_WORD = r"[^\p{L}\p{N}_]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times inside `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def any_word(words: Sequence[str]) -> str:
    """Pattern: any of the words or phrases, bounded by non-word characters (holds for accented letters as well)."""
    return f"(^|{NON_WORD})({'|'.join(words)})({NON_WORD}|$)"


def contains_any(c: Column, needles: Sequence[str]) -> Column:
    """A balanced tree of tests, so that a long word list stays a shallow expression."""
    tests = [F.contains(c, F.lit(n)) for n in needles] or [F.lit(False)]
    while len(tests) > 1:
        tests = [a | b for a, b in zip(tests[::2], tests[1::2])] + tests[len(tests) // 2 * 2:]
    return tests[0]


def strip(c: Column) -> Column:
    """White space of any kind off both ends (trim() takes blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def has_word(c: Column, words: Sequence[str]) -> Column:
    """Any of the words as whole words; the cheap substring test runs first and spares most texts the pattern."""
    return let(F.lower(squeeze(c)), lambda low: has_word_low(low, words))


def squeeze(c: Column) -> Column:
    """Whitespace normalization; null becomes the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.lower(strip(c)), "[^a-z0-9_]+", "_")
    return F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_|_$", "")


def stable_id(*parts: Column) -> Column:
    """Digest of the parts; a missing part counts as the word None, so it can't be mistaken for a shorter list."""
    return F.md5(F.concat_ws("||", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]))


def centiseconds(ms: Column) -> Column:
    """Milliseconds as seconds with two decimals, rounded half up in integers."""
    cs = F.floor((ms + 5) / 10)
    return F.format_string("%d.%02d", F.floor(cs / 100), cs % 100)


def tokens(c: Column) -> Column:
    """Whitespace tokens, empty array for blank text."""
    return let(squeeze(c), lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " ")))


def collapse_tokens(c: Column) -> Column:
    """Drop every token equal (ignoring case) to the one before it."""
    return F.array_join(let(F.split(squeeze(c), " "), lambda t: F.filter(
        t, lambda x, i: (i == 0) | (F.lower(x) != F.lower(F.get(t, i - 1))))), " ")


def drop_repeated_sentences(c: Column) -> Column:
    """Keep the first of equal sentences (ignoring case); a sentence ends at . ? or ! before whitespace."""
    parts = F.filter(F.split(c, r"(?U)(?<=[.?!])\s+"), lambda p: p != "")
    return F.array_join(let(parts, lambda ps: let(
        F.transform(ps, lambda p: F.lower(p)),
        lambda low: F.filter(ps, lambda p, i: F.array_position(low, F.lower(p)) == i + 1))), " ")


def cleanup_repeats(c: Column) -> Column:
    return F.trim(drop_repeated_sentences(collapse_tokens(c)))


def clean_line(c: Column) -> Column:
    """Hesitations out, spacing before , and . fixed, punctuation runs collapsed, repeats removed."""
    t = F.regexp_replace(squeeze(c), rf"(?iuU)\b({'|'.join(fixed.HESITATIONS)})\b", "")
    t = F.replace(F.replace(t, F.lit(" ,"), F.lit(",")), F.lit(" ."), F.lit("."))
    t = F.regexp_replace(t, r"([,.?!])\1{1,}", "$1")
    return squeeze(cleanup_repeats(t))


def is_filler(c: Column) -> Column:
    return F.btrim(F.lower(squeeze(c)), F.lit(" .,!?:;-")).isin(fixed.FILLERS)


def is_transition(c: Column) -> Column:
    heads = [p.split(".*")[0] for p in fixed.TRANSITIONS]
    return let(F.lower(squeeze(c)), lambda low: contains_any(low, heads) & low.rlike("|".join(f"({p})" for p in fixed.TRANSITIONS)))


def noise_score(c: Column) -> Column:
    one = lambda cond, n=1: F.when(cond, F.lit(n)).otherwise(F.lit(0))
    return let(F.lower(squeeze(c)), lambda low: (
        one(has_word_low(low, fixed.NOISE_FILLERS)) + one(low.rlike(r"(?iu)([a-zA-ZÀ-ỹ]+)((?U)\s+\1){2,}"))
        + one(contains_any(low, fixed.ARTIFACTS), 2))) + one(c.rlike(r"[!?.]{2,}"))


def is_hallucination(c: Column, dur_ms: Column, words_per_sec: float = 8.0) -> Column:
    """Too many words for the time (strictly), or at least eight words whose first half repeats as the second."""
    def judge(w: Column) -> Column:
        n, half = F.size(w), F.floor(F.size(w) / 2).cast("int")
        fast = (dur_ms > 0) & (n * 1000 > dur_ms * F.lit(words_per_sec))
        twice = (n >= 8) & (F.slice(w, F.lit(1), half) == F.slice(w, half + 1, half))
        return (n > 0) & (fast | twice)
    return let(tokens(c), judge)


def is_asr_artifact(c: Column) -> Column:
    low = F.lower(strip(c))
    return contains_any(low, fixed.ASR_ARTIFACTS) | low.isin(fixed.STRAY_WORDS)


def token_similarity(a: Column, b: Column) -> Column:
    """|A & B| / max(|A|, |B|) over lower-cased token sets, 0 when either is empty."""
    return set_similarity(token_set(a), token_set(b))


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(F.lower(c)))


def set_similarity(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)))


def speaker_of_name(name: Column, default: str = "speaker_unknown") -> Column:
    """The part after the last underscore; the whole name without one."""
    return F.coalesce(F.substring_index(F.nullif(name, F.lit("")), "_", -1), F.lit(default))


def hhmmss(sec: Column) -> Column:
    s = F.floor(F.coalesce(sec, F.lit(0))).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def minutes_seconds(sec: Column) -> Column:
    s = F.greatest(sec, F.lit(0.0))
    return F.when(s < 60, F.format_string("%.2fs", s)).otherwise(
        F.format_string("%dm %ds", F.floor(s / 60), F.floor(s % 60).cast("long")))


def mmss(sec: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(sec / 60), F.floor(sec % 60).cast("long"))


def low_squeezed(c: Column) -> Column:
    """What the `_low` rules read. Squeezing costs more than most rules, so texts that several rules read are squeezed once."""
    return F.lower(squeeze(c))


def tech_tags(c: Column) -> Column:
    """Dictionary terms found in the text, in dictionary order; terms up to 4 characters must be whole words."""
    return let(low_squeezed(c), tech_tags_low)


def tech_tags_low(low: Column) -> Column:
    terms = F.array(*[F.lit(t) for t in fixed.TECH_TERMS])
    short = [t for t in fixed.TECH_TERMS if len(t) <= 4]

    # the text is tokenized only where a short term occurs at all
    words = F.when(contains_any(low, short), F.split(low, f"{NON_WORD}+")).otherwise(F.array().cast("array<string>"))
    return let(words, lambda toks: F.filter(terms, lambda t: F.contains(low, t) & ((F.length(t) > 4) | F.array_contains(toks, t))))


def has_action_hint(c: Column) -> Column:
    return has_word(c, fixed.ACTION_WORDS)


def has_issue(c: Column) -> Column:
    return has_word(c, fixed.ISSUE_WORDS)


def has_format(c: Column) -> Column:
    return has_word(c, fixed.FORMAT_WORDS)


def has_word_low(low: Column, words: Sequence[str]) -> Column:
    return contains_any(low, words) & low.rlike(any_word(words))


def segment_type(c: Column, transition_heavy: Column) -> Column:
    return let(low_squeezed(c), lambda low: segment_type_low(
        low, has_word_low(low, fixed.FORMAT_WORDS), has_word_low(low, fixed.ISSUE_WORDS), transition_heavy))


def segment_type_low(low: Column, is_format: Column, is_issue: Column, transition_heavy: Column) -> Column:
    return (F.when(is_format, "formatting_review").when(is_issue, "issue_report")
            .when(contains_any(low, fixed.PLANNING_KEYS), "planning").when(contains_any(low, fixed.PROGRESS_KEYS), "progress_update")
            .when(contains_any(low, fixed.TECHNICAL_KEYS), "technical_discussion").when(transition_heavy, "presentation_prep").otherwise("other"))


def lookup(key: Column, table: dict[str, str], default: str) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def type_overview(kind: Column, tags: Column) -> Column:
    """The overview sentence of a segment type, naming up to four tags where the type takes them."""
    listed = F.array_join(F.slice(tags, 1, 4), ", ")
    out = None
    for k, (head, link) in fixed.TYPE_OVERVIEWS.items():
        text = F.lit(head + ".") if link is None else F.when(
            F.size(tags) > 0, F.concat(F.lit(head + link), listed, F.lit("."))).otherwise(F.lit(head + "."))
        out = F.when(kind == k, text) if out is None else out.when(kind == k, text)
    return out.otherwise(F.lit(fixed.TYPE_OVERVIEWS["other"][0] + "."))


def action_status(c: Column) -> Column:
    return let(F.lower(squeeze(c)), lambda low: (F.when(contains_any(low, fixed.DONE_KEYS), "done")
               .when(contains_any(low, fixed.IN_PROGRESS_KEYS), "in_progress").otherwise("open")))


def speaker_role(c: Column) -> Column:
    return let(low_squeezed(c), speaker_role_low)


def speaker_role_low(low: Column) -> Column:
    return F.when(contains_any(low, fixed.ASKED_KEYS), "asked").when(contains_any(low, fixed.PROPOSED_KEYS), "proposed").otherwise("reported")


def wer_normalize(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}_\s]", ""))


def mentioned_speaker(question: Column, aliases: dict[str, list[str]] = fixed.SPEAKER_ALIASES) -> Column:
    """Canonical name of the first alias (in dictionary order) contained in the question, null if none."""
    low = F.lower(question)
    out = None
    for name, names in aliases.items():
        hit = contains_any(low, names)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def unfence_json(c: Column) -> Column:
    """The JSON inside a model answer: code fences off, from the first to the last bracket."""
    t = strip(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(t, r"(?i)^```(?:json)?\s*", "")
    t = F.regexp_replace(t, r"\s*```$", "")
    hit = F.regexp_extract(t, r"(?s)[\[{].*[\]}]", 0)
    return F.when(hit != "", hit).otherwise(t)
