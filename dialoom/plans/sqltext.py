"""SQL twins of the text rules, as text fragments for DuckDB."""

from __future__ import annotations

from dialoom.functions import fixed

NW = r"[^\p{L}\p{N}_]"


def lst(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sq(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def word_rx(words) -> str:
    return f"(^|{NW})({'|'.join(words)})({NW}|$)"


def has_word(x: str, words) -> str:
    return f"regexp_matches(lower({sq(x)}), '{word_rx(words)}')"


def any_in(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains(lower({sq(x)}), '{n}')" for n in needles) + ")"


def tags(x: str) -> str:
    return (f"list_filter({lst(fixed.TECH_TERMS)}, lambda t: CASE WHEN length(t) <= 4 THEN "
            f"list_contains(regexp_split_to_array(lower({sq(x)}), '{NW}+'), t) ELSE contains(lower({sq(x)}), t) END)")


def noise(x: str, low: str, words: str) -> str:
    """Noise score of a text `x`, given its squeezed lower form and that form's words."""
    return (f"CAST(CASE WHEN regexp_matches({low}, '{word_rx(fixed.NOISE_FILLERS)}') THEN 1 ELSE 0 END"
            f" + CASE WHEN len(list_filter(range(1, greatest(len({words}) - 1, 1)), lambda i: regexp_full_match({words}[i+1], '[a-zA-ZÀ-ỹ]+')"
            f" AND suffix({words}[i], {words}[i+1]) AND starts_with({words}[i+2], {words}[i+1]))) > 0 THEN 1 ELSE 0 END"
            f" + CASE WHEN {' OR '.join(f"contains({low}, '{a}')" for a in fixed.ARTIFACTS)} THEN 2 ELSE 0 END"
            f" + CASE WHEN regexp_matches({x}, '[!?.]{{2,}}') THEN 1 ELSE 0 END AS INTEGER)")


def transition(x: str) -> str:
    return f"regexp_matches(lower({sq(x)}), '{'|'.join('(' + p + ')' for p in fixed.TRANSITIONS)}')"


def kind(x: str, heavy: str) -> str:
    return (f"CASE WHEN {has_word(x, fixed.FORMAT_WORDS)} THEN 'formatting_review' "
            f"WHEN {has_word(x, fixed.ISSUE_WORDS)} THEN 'issue_report' WHEN {any_in(x, fixed.PLANNING_KEYS)} THEN 'planning' "
            f"WHEN {any_in(x, fixed.PROGRESS_KEYS)} THEN 'progress_update' "
            f"WHEN {any_in(x, fixed.TECHNICAL_KEYS)} THEN 'technical_discussion' "
            f"WHEN {heavy} THEN 'presentation_prep' ELSE 'other' END")


def status(x: str) -> str:
    return (f"CASE WHEN {any_in(x, fixed.DONE_KEYS)} THEN 'done' WHEN {any_in(x, fixed.IN_PROGRESS_KEYS)} "
            f"THEN 'in_progress' ELSE 'open' END")


def role(x: str) -> str:
    return (f"CASE WHEN {any_in(x, fixed.ASKED_KEYS)} THEN 'asked' WHEN {any_in(x, fixed.PROPOSED_KEYS)} "
            f"THEN 'proposed' ELSE 'reported' END")


def pick(x: str, table: dict, default: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{default}' END"


def overview(kind_: str, tags_: str) -> str:
    out = []
    for k, (head, link) in fixed.TYPE_OVERVIEWS.items():
        body = f"'{head}.'" if link is None else (
            f"CASE WHEN len({tags_}) > 0 THEN '{head}{link}' || array_to_string({tags_}[1:4], ', ') || '.' ELSE '{head}.' END")
        out.append(f"WHEN '{k}' THEN {body}")
    return f"CASE {kind_} {' '.join(out)} ELSE '{fixed.TYPE_OVERVIEWS['other'][0]}.' END"


def cleanup_steps(src: str, ids: str, x: str, out: str) -> list[str]:
    """CTEs collapsing adjacent equal tokens and dropping repeated sentences (x must not contain chr(1))."""
    return [
        f"{out}_1 AS MATERIALIZED (SELECT {ids}, string_split({sq(x)}, ' ') AS toks FROM {src})",
        rf"""{out}_2 AS MATERIALIZED (SELECT {ids}, list_filter(string_split(regexp_replace(array_to_string(list_filter(toks,
            lambda t, i: i = 1 OR lower(t) <> lower(toks[i-1])), ' '), '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda p: p <> '') AS parts FROM {out}_1)""",
        f"{out}_3 AS MATERIALIZED (SELECT {ids}, parts, list_transform(parts, lambda q: lower(q)) AS low FROM {out}_2)",
        f"{out} AS MATERIALIZED (SELECT {ids}, trim(array_to_string(list_filter(parts, lambda p, j: list_position(low, lower(p)) = j), ' ')) AS cleaned FROM {out}_3)"]


def pre_clean(x: str) -> str:
    """Hesitations, comma and dot spacing, punctuation runs."""
    t = rf"regexp_replace({sq(x)}, '(^|{NW})({'|'.join(fixed.HESITATIONS)})({NW}|$)', '\1\3', 'gi')"
    t = f"replace(replace({t}, ' ,', ','), ' .', '.')"
    for ch in (",", ".", "?", "!"):
        t = f"regexp_replace({t}, '[{ch}]{{2,}}', '{ch}', 'g')"
    return t
