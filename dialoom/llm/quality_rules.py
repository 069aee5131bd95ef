"""Quality rules with host verdicts.

Every document gets counts over its whole text and rule verdicts. A hard rule rejects the document itself. Soft rules
count for its host: failures are summed per host, the hosts' rates are shrunk by a beta prior fitted to all hosts by
moments, and a host whose shrunk rate is above `host_limit` loses those of its documents that break a soft rule.
Clean documents stay, whatever their host.

A host may hold a third of all rows: sums are partial before any shuffle, and the host table (one row per host) meets the
documents in a join that may split a host's rows.

Defined cases: a null or empty text has no words and fails the hard rule; a null host is a host of its own; repeated
rows are judged one by one; columns of any name are kept by `filtered`; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import arrow_map, fresh, text_bytes, texts, written

SYMBOL = re.compile(rb"[#*$%&|<>]")
SPACE = b" \t\n\r\x0b\x0c"
COUNTS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long"}


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text holds twice or more, first occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    size = len(number)
    if size < 2_000_000:
        key = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:                                             # three numbers no longer fit one: number the pairs first
        pair = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
        key = pair[:-1] * size + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= twice
    return int(covered.sum())


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    joined = b"".join(words)
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    continuation = np.frombuffer(joined, np.int8)
    return (len(words), len(joined) - int(np.count_nonzero(continuation < -64)), len(SYMBOL.findall(text)),
            len(lines) - len(set(lines)), repeat_words(words))


def counted(docs: DataFrame, text_col: str = "text", prefix: str = "", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) of `docs` and the counts of each text (named after `prefix`). No shuffle."""
    raw, = fresh(docs, "text_bytes")
    keep = docs.columns if keep is None else keep

    def step(batch):
        got = [measures(t) for t in texts(batch, raw)]
        yield {c: batch.column(c) for c in keep} | {prefix + n: [g[k] for g in got] for k, n in enumerate(COUNTS)}

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], text_bytes(docs, text_col, raw))
    return arrow_map(rows, step, {prefix + n: t for n, t in COUNTS.items()}, keep=keep)


def rule_columns(prefix: str = "", min_words: int = 50, max_repeat_pct: int = 50, max_symbol_pct: int = 10,
                 max_dup_lines: int = 10, word_length: tuple[float, float] = (2.0, 15.0)):
    """(hard, soft): a document's own failure, and the failure that counts for its host."""
    c = {n: F.col(prefix + n) for n in COUNTS}
    hard = (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeat_pct * c["n_words"])
    mean = c["word_chars"] / F.greatest(c["n_words"], F.lit(1))
    soft = (hard | (100 * c["n_symbols"] > max_symbol_pct * c["n_words"]) | (c["n_dup_lines"] > max_dup_lines)
            | (mean < word_length[0]) | (mean > word_length[1]))
    return hard, soft


def host_rates(judged: DataFrame, host: str, soft: str) -> DataFrame:
    """One row per host: its failure rate, shrunk towards a beta prior that is fitted to the rates of all hosts."""
    hosts = written(judged.groupBy(host).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(soft).cast("long")).alias("bad")), "hosts")
    rate = F.col("bad") / F.col("n")
    m, v, inv = hosts.agg(F.avg(rate), F.coalesce(F.var_samp(rate), F.lit(0.0)), F.avg(1 / F.col("n"))).first()
    m, v, inv = m or 0.0, v or 0.0, inv or 0.0
    spread = max(v - m * (1 - m) * inv, 1e-6)         # spread of the true rates: the observed one less the binomial part
    weight = min(max(m * (1 - m) / spread - 1, 1.0), 1e6)
    return hosts.select(host, ((F.col("bad") + m * weight) / (F.col("n") + weight)).alias("host_rate"))


def judge(docs: DataFrame, host_col: str = "source", text_col: str = "text", host_limit: float = 0.5, prefix: str = "",
          keep: list[str] | None = None, **limits) -> DataFrame:
    """The columns `keep` (default: all), the counts, base_failed, soft_failed, host_rate and kept (all after `prefix`).

    Texts that are not kept are read once; otherwise twice, so that no text is written or shuffled. The written host
    table is broadcast by Spark if it is below its threshold, else joined with skew splitting.
    """
    hard, soft = rule_columns(prefix, **limits)
    p, keep = prefix, docs.columns if keep is None else keep
    host, = fresh(docs, "host_key")
    rows = docs.withColumn(host, F.coalesce(F.concat(F.lit("="), F.col(f"`{host_col}`").cast("string")), F.lit("")))
    flags = {p + "base_failed": hard, p + "soft_failed": soft}
    if text_col in keep:
        once = counted(rows, text_col, p, [host]).withColumns(flags)
        rows = counted(rows, text_col, p, [*keep, host]).withColumns(flags)
    else:
        once = rows = written(counted(rows, text_col, p, [*keep, host]).withColumns(flags), "judged")
    verdict = written(host_rates(once.select(host, p + "soft_failed"), host, p + "soft_failed"), "host-rates")
    out = rows.join(verdict.withColumnRenamed("host_rate", p + "host_rate"), host).drop(host)
    return out.withColumn(p + "kept", ~F.col(p + "base_failed") & ~((F.col(p + "host_rate") > host_limit) & F.col(p + "soft_failed")))


def filtered(docs: DataFrame, host_col: str = "source", text_col: str = "text", **limits) -> DataFrame:
    """The rows of `docs` that are kept, with their own columns."""
    prefix = "_q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    out = judge(docs, host_col, text_col, prefix=prefix, **limits)
    return out.where(F.col(prefix + "kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
