"""Small hostile document tables and plain restatements of what the operators must give."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, source string, ids string, k1 int, row string, n_words string, text_bytes string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng: random.Random, n: int, words=WORDS) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    """(id, text): nulls, empty and blank texts, copies, near copies, shared passages, long and odd texts."""
    rng = random.Random(7)
    many = [w + str(i) for w in WORDS for i in range(40)]
    passage, long = prose(rng, 60, many), prose(rng, 20_000, many)
    base = prose(rng, 300, many)
    near = base.split()
    near[50] = "changed"
    out: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \t\n "), (4, base), (5, base), (6, " ".join(near)), (7, long), (None, prose(rng, 80, many)), (None, None),
        (8, prose(rng, 30, many) + "\n" + passage + "\n" + prose(rng, 30, many)), (9, passage), (10, prose(rng, 40, many) + " " + passage),
        (11, "a a a a " * 30), (12, "É ß <|endoftext|> x y 中文 👍 Ünï-code's I'll 1234\n\n\n  end  "), (13, "x" * 5000),
        (14, "\n".join(["The same short line here now.", "the same short line HERE now", "short", "short", prose(rng, 12, many)])),
        (15, "# * $ % & | < > " * 20), (16, prose(rng, 60)), (17, prose(rng, 60)), (18, prose(rng, 60))]
    out += [(20 + i, prose(rng, rng.randint(1, 120), many[:200])) for i in range(20)]
    return out + [(4, base), (3, " \t\n "), (16, out[16][1])]


def rows():
    return [(i, t, f"s{(i or 0) % 3}" if i != 20 else None, "x", 5, "r", "w", "b") for i, t in texts()]


def words(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def grouped(n: int, links) -> list[int]:
    """Root of each of n items under links, by plain union."""
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]
