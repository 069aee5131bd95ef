"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Numbers and dates that pass their validity rules (card numbers by check digit, calendar dates, IPv4 octets, phone and
social-security number ranges) are permuted inside the set of values of their own format by a keyed Feistel network: two
halves, each round adding a keyed hash of the one half to the other, modulo that half's size. It is a permutation, so
equal values get equal pseudonyms in all documents and different values stay different; punctuation stays as it was, and a
pseudonym is itself valid. The local part of mail addresses and labelled secrets go through the same network letter by
letter, digits staying digits. Values that fail their rule are left alone.

Each row is rewritten where it is: no shuffle, no Python. Matches are bounded in length, and a match can only begin where
its characters begin, so a long run of letters or digits costs linear time.

Defined cases: null text stays null, with no finds; empty text stays empty; other columns stay; repeated rows are rewritten
alike; empty tables are allowed. The key is a parameter; whoever holds it can undo the permutation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import fresh

SECRET = r"\bAKIA[0-9A-Z]{16}\b|(?i:\b(?:password|passwd|secret|token|api_?key)\b ?[=:] ?\"?[0-9A-Za-z_+/-]{8,128}+)"
MAIL = r"(?<![0-9A-Za-z._%+-])[0-9A-Za-z._%+-]{1,64}+@[0-9A-Za-z-]{1,63}(?:\.[0-9A-Za-z-]{1,63}){1,8}"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
# The usual shapes of cards go first, with at most a short number behind them (a card's own last digits, or a CVV or count); a
# looser run doesn't go on into one of these shapes. So a number beside a card can't hide it.
SHAPE = r"(?:[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{4,5}|[0-9]{4}-[0-9]{6}-[0-9]{4,5}|[0-9]{13,19})(?![0-9])"
BEHIND = r"(?:[ -][0-9]{1,3}(?![0-9/.]|[ -][0-9]))?"
CARD = rf"(?<![0-9])(?:{SHAPE}{BEHIND}|(?:[0-9](?:[ -](?!{SHAPE}))?){{12,18}}[0-9](?![0-9]))"
# Every kind has one of these, so most texts are passed over by one quick look.
HINT = r"[0-9@=:]|AKIA"
FOUND = "|".join((SECRET, MAIL, IPV4, DATE, SSN, PHONE, CARD))
KINDS = {"secret": SECRET, "mail": MAIL, "ipv4": IPV4, "date": DATE, "ssn": SSN, "phone": PHONE, "card": CARD}
FIRST_DAY, DAYS = "1900-01-01", 73_049            # to 2099-12-31
ROUNDS = 10


def part(s: Column, start, length) -> Column:
    return s.substr(F.lit(start) if isinstance(start, int) else start, F.lit(length) if isinstance(length, int) else length)


def long(c: Column) -> Column:
    return c.cast("long")


def keyed_number(key: Column, tag: str, r: Column, x: Column, start: Column | None = None, digits: int = 15) -> Column:
    h = F.sha2(F.concat_ws("|", key, F.lit(tag), r.cast("string"), x.cast("string")).cast("binary"), 256)
    return long(F.conv(part(h, F.lit(1) if start is None else start, digits), 16, 10))


def feistel(key: Column, tag: str, a: Column, size_a: Column, b: Column, size_b: Column) -> Column:
    """struct(a, b): the pair permuted within size_a x size_b."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(long(a).alias("a"), long(b).alias("b")),
        lambda s, r: F.when(r % 2 == 0, F.struct(F.pmod(s["a"] + keyed_number(key, tag, r, s["b"]), size_a).alias("a"), s["b"].alias("b")))
        .otherwise(F.struct(s["a"].alias("a"), F.pmod(s["b"] + keyed_number(key, tag, r, s["a"]), size_b).alias("b"))))


def padded(n: Column, width) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def with_digits(m: Column, digits: Column) -> Column:
    """`m` with its digits replaced in order."""
    def at(i):
        c = part(m, i, 1)
        return F.when(c.between("0", "9"), part(digits, F.length(digits_of(part(m, 1, i))), 1)).otherwise(c)
    return F.concat_ws("", F.transform(F.sequence(F.lit(1), F.length(m)), at))


def check_digit(payload: Column) -> Column:
    def add(total, i):
        d = part(payload, F.length(payload) - i + 1, 1).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)
    total = F.aggregate(F.sequence(F.lit(1), F.length(payload)), F.lit(0), add)
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def named(value: Column, use) -> Column:
    """use(value), with the value computed once and written into the plan once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def card(m: Column, key: Column) -> Column:
    def passes(d: Column) -> Column:
        n = F.length(d)
        return n.between(13, 19) & (check_digit(part(d, F.lit(1), n - 1)) == part(d, n, F.lit(1)))

    def moved(own: Column) -> Column:
        def change(d: Column) -> Column:
            n = F.length(d)
            half = F.floor((n - 2) / 2).cast("int")
            rest = n - 2 - half
            ten = lambda k: long(F.rpad(F.lit("1"), k + 1, "0"))
            new = feistel(key, "card", part(d, F.lit(2), half), ten(half), part(d, half + 2, rest), ten(rest))
            payload = F.concat(part(d, 1, 1), padded(new["a"], half), padded(new["b"], rest))
            return F.when(passes(d), F.concat(with_digits(own, F.concat(payload, check_digit(payload))), part(m, F.length(own) + 1, F.length(m))))
        return named(digits_of(own), change)

    def head_or_all(head: Column) -> Column:
        return named(digits_of(head), lambda d: F.when(passes(d), head).otherwise(m))
    return named(named(F.regexp_extract(m, f"^{SHAPE}", 0), head_or_all), moved)


def phone(m: Column, key: Column) -> Column:
    d = digits_of(m)
    ten = part(d, F.length(d) - 9, F.lit(10))
    new = feistel(key, "phone", F.concat(part(ten, 2, 2), part(ten, 5, 2)), F.lit(10_000), part(ten, 7, 4), F.lit(10_000))
    area = padded(new["a"], 4)
    out = F.concat(part(d, F.lit(1), F.length(d) - 10), part(ten, 1, 1), part(area, 1, 2), part(ten, 4, 1), part(area, 3, 2), padded(new["b"], 4))
    return F.when((part(ten, 1, 1) >= "2") & (part(ten, 4, 1) >= "2"), with_digits(m, out))


def ipv4(m: Column, key: Column) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: long(x))
    new = feistel(key, "ipv4", o[0] * 256 + o[1], F.lit(65_536), o[2] * 256 + o[3], F.lit(65_536))
    text = F.concat_ws(".", *[x.cast("string") for x in (F.floor(new["a"] / 256), new["a"] % 256, F.floor(new["b"] / 256), new["b"] % 256)])
    return F.when(F.forall(o, lambda x: x <= 255), text)


def ssn(m: Column, key: Column) -> Column:
    area, group, serial = long(part(m, 1, 3)), long(part(m, 5, 2)), long(part(m, 8, 4))
    valid = (area >= 1) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = area - F.when(area > 666, 2).otherwise(1)                     # 898 areas
    new = feistel(key, "ssn", place * 33 + F.floor((group - 1) / 3), F.lit(898 * 33), (group - 1) % 3 * 9_999 + serial - 1, F.lit(3 * 9_999))
    p = F.floor(new["a"] / 33)
    out = F.concat(padded(p + F.when(p > 664, 2).otherwise(1), 3), padded(new["a"] % 33 * 3 + F.floor(new["b"] / 9_999) + 1, 2), padded(new["b"] % 9_999 + 1, 4))
    return F.when(valid, with_digits(m, out))


def date(m: Column, key: Column) -> Column:
    iso, dmy, mdy = "yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy"
    read = lambda f: F.try_to_timestamp(m, F.lit(f)).cast("date")
    day = F.when(part(m, 5, 1) == "-", read(iso)).otherwise(F.coalesce(read(mdy), read(dmy)))
    n = F.date_diff(day, F.lit(FIRST_DAY).cast("date"))
    new = feistel(key, "date", n % 319, F.lit(319), F.floor(n / 319), F.lit(DAYS // 319))
    out = F.date_add(F.lit(FIRST_DAY).cast("date"), (new["b"] * 319 + new["a"]).cast("int"))
    text = F.when(part(m, 5, 1) == "-", F.date_format(out, iso)).when(read(mdy).isNotNull(), F.date_format(out, mdy)).otherwise(F.date_format(out, dmy))
    return F.when(day.isNotNull() & n.between(0, DAYS - 1), text)


def letters(s: Column, key: Column, tag: str) -> Column:
    """A string permuted within strings of the same character classes."""
    half = F.floor((F.length(s) + 1) / 2).cast("int")

    def moved(mine: Column, other: Column, r: Column) -> Column:
        def at(i):
            c = F.ascii(part(mine, i, 1))
            off = keyed_number(key, tag, r, F.concat_ws("|", i.cast("string"), other), None, 8)
            turn = lambda base, n: F.char(base + F.pmod(c - base + off, F.lit(n)))
            return (F.when(c.between(48, 57), turn(48, 10)).when(c.between(65, 90), turn(65, 26)).when(c.between(97, 122), turn(97, 26))
                    .otherwise(part(mine, i, 1)))
        return F.when(F.length(mine) > 0, F.concat_ws("", F.transform(F.sequence(F.lit(1), F.length(mine)), at))).otherwise(F.lit(""))

    out = F.aggregate(
        F.sequence(F.lit(0), F.lit(3)), F.struct(part(s, F.lit(1), half).alias("a"), part(s, half + 1, F.length(s)).alias("b")),
        lambda x, r: F.when(r % 2 == 0, F.struct(moved(x["a"], x["b"], r).alias("a"), x["b"].alias("b")))
        .otherwise(F.struct(x["a"].alias("a"), moved(x["b"], x["a"], r).alias("b"))))
    return F.concat(out["a"], out["b"])


def mail(m: Column, key: Column) -> Column:
    at = F.instr(m, "@")
    return F.concat(letters(part(m, F.lit(1), at - 1), key, "mail"), part(m, at, F.length(m)))


def secret(m: Column, key: Column) -> Column:
    head = F.regexp_extract(m, r"^(?:AKIA|[A-Za-z_]+ ?[=:] ?\"?)", 0)
    return F.concat(head, letters(part(m, F.length(head) + 1, F.length(m)), key, "secret"))


RULES = {"secret": secret, "mail": mail, "ipv4": ipv4, "date": date, "ssn": ssn, "phone": phone, "card": card}


def replaced(m: Column, key: Column) -> Column:
    """struct(kind, new) of a match; kind is null and new the match itself if no rule accepts it."""
    new, kind = m, F.lit(None).cast("string")
    for name in reversed(RULES):
        fits = m.rlike(f"^(?:{KINDS[name]})$")
        made = RULES[name](m, key)
        kind = F.when(fits, F.when(made.isNotNull(), F.lit(name))).otherwise(kind)
        new = F.when(fits, F.coalesce(made, m)).otherwise(new)
    return F.struct(kind.alias("kind"), new.alias("new"))


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", finds_col: str = "finds") -> DataFrame:
    """`docs` with personal data in `text_col` replaced, and `finds_col`: array of (kind, new) in text order."""
    found, = fresh(docs, "found")
    text, finds = F.col(f"`{text_col}`"), F.col(found)
    rows = docs.withColumn(found, F.when(text.rlike(HINT) & text.rlike(FOUND), F.transform(
        F.regexp_extract_all(text, F.lit(FOUND), 0), lambda m: replaced(m, F.lit(key)))))
    between = F.split(text, FOUND, -1)
    joined = F.concat_ws("", F.transform(between, lambda p, i: F.concat(p, F.coalesce(F.get(finds, i)["new"], F.lit("")))))
    empty = F.array().cast("array<struct<kind:string,new:string>>")
    return rows.withColumn(text_col, F.when(finds.isNull(), text).otherwise(joined)).withColumn(
        finds_col, F.coalesce(F.filter(finds, lambda x: x["kind"].isNotNull()), empty)).select(*[F.col(f"`{c}`") for c in docs.columns], finds_col)
