"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Validated values are permuted, under a key, within the set of values of their
own format, so a card stays a card, a date a date, and equal values get equal
pseudonyms in every document.  The permutation is a Feistel network on a pair
(x mod a, y mod b): eight rounds of adding a keyed hash of one half to the
other, which is a bijection for any a and b:

* card numbers of 13-19 digits with a valid check digit, alone or beside other
  groups of digits (an expiry date, a security code): the digits before the
  check digit are permuted, the check digit is computed again;
* telephone numbers of ten digits after +1;
* IPv4 addresses: 65,536 x 65,536;
* calendar dates of 1800-2199 (ISO, or day first with dots or slashes): their
  146,097 days are 189 x 773;
* the local part of e-mail addresses: letters and digits in base 36, in chunks
  of at most 24 characters.

Separators stay where they are.  Everything is SQL functions on one row: no
Python code, no shuffle, no state.

Defined cases: null and empty texts stay; values that fail validation stay;
repeated rows give equal results; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import free_name, open_table

ROUNDS = 8

# The formats (Java regular expressions).
#: Digits in groups with one blank or hyphen between them, 13 digits at least in
#: all; the quantifier gives nothing back, so long runs need no stack.
DIGIT_RUN = r"(?=[0-9])(?<![0-9])(?<![0-9]\.)[0-9](?:[ -]?[0-9]){12,}+"
#: Whole groups of a given number of digits, from every group on; not after a +.
CARD = r"(?=[0-9])(?<![0-9+])(?=([0-9](?:[ -]?[0-9]){{{}}})(?![0-9]))"
#: Groups that a card beside other digits is written in.
CARD_GROUPS = "^(?:[0-9]{4,}[ -])*[0-9]{3,}$"
PHONE = r"\+1[ -]?\(?[0-9]{3}\)?[ -]?[0-9]{3}-?[0-9]{4}(?![0-9])"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
ISO_DATE = r"(?<![0-9-])(?:18|19|20|21)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9-])"
DAY_DATE = r"(?<![0-9./])[0-9]{2}([./])[0-9]{2}\1(?:18|19|20|21)[0-9]{2}(?![0-9/])"
#: The look-ahead spares all other characters the alternatives.
NUMBERS = "(?=[+0-9])(?:" + "|".join([PHONE, ISO_DATE, DAY_DATE, IPV4]) + ")"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?=[A-Za-z0-9-]{1,63}\.[A-Za-z0-9])"


def feistel(x: Column, y: Column, a: Column, b: Column, key: str, tag: Column) -> Column:
    """struct(x, y) permuted within 0 <= x < a, 0 <= y < b."""
    def noise(i: Column, v: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), tag, i.cast("string"), v.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 14), 16, 10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        even = F.struct(F.pmod(s["x"] + noise(i, s["y"]), a).alias("x"), s["y"].alias("y"))
        odd = F.struct(s["x"].alias("x"), F.pmod(s["y"] + noise(i, s["x"]), b).alias("y"))
        return F.when(i % 2 == 0, even).otherwise(odd)
    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))),
                       F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), turn)


def _padded(number: Column, width: Column) -> Column:
    return F.lpad(number.cast("string"), width, F.lit("0"))


def _refill(shape: Column, characters: Column, kind: str) -> Column:
    """``shape`` with its digits (or letters and digits) replaced in order."""
    gaps = F.split(shape, f"[{kind}]", -1)
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(
        F.when(i > 0, F.substring(characters, i, F.lit(1))).otherwise(F.lit("")), g)), "")


def _luhn(digits: Column, double_last: bool) -> Column:
    """Sum of the digits with every second one doubled (counted from the end)."""
    n = F.length(digits)
    places = F.sequence(F.lit(1), n)
    want = F.lit(0 if double_last else 1)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(F.pmod(n - i, F.lit(2)) == want, twice).otherwise(d)
    return F.aggregate(places, F.lit(0), add)


def _pair(text: Column, base: int, key: str, tag: Column) -> Column:
    """A string of letters and digits (base 36) or digits (base 10), permuted."""
    n = F.length(text)
    u = F.floor(n / 2).cast("int")
    v = n - u

    def number(part: Column) -> Column:
        return F.coalesce(F.conv(part, base, 10).cast("long"), F.lit(0))

    def size(k: Column) -> Column:
        return F.round(F.pow(F.lit(float(base)), k)).cast("long") if base == 10 else F.aggregate(
            F.sequence(F.lit(0), k), F.lit(1).cast("long"),
            lambda s, i: F.when(i > 0, s * base).otherwise(s))
    out = feistel(number(F.substring(text, F.lit(1), u)), number(F.substring(text, u + 1, v)),
                  size(u), size(v), key, F.concat_ws("|", tag, n.cast("string")))

    def back(value: Column, k: Column) -> Column:
        return F.when(k > 0, F.lower(_padded(F.conv(value.cast("string"), 10, base), k))).otherwise(F.lit(""))
    return F.concat(back(out["x"], u), back(out["y"], v))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match of NUMBERS, or the match if it is not valid."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    phone = _refill(m, F.concat(F.lit("1"), _pair(F.substring(digits, 2, 10), 10, key, F.lit("phone"))), "0-9")

    octet = F.transform(F.split(m, r"\."), lambda o: o.cast("long"))
    p = feistel(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], F.lit(65536), F.lit(65536), key, F.lit("ip"))
    parts = [F.floor(p["x"] / 256), p["x"] % 256, F.floor(p["y"] / 256), p["y"] % 256]
    ip = F.when(F.array_max(octet) < 256, F.concat_ws(".", *(c.cast("string") for c in parts)))

    def date(year: Column, month: Column, day: Column, write) -> Column:
        first = F.make_date(year, F.when(month.between(1, 12), month), F.lit(1))
        valid = (day >= 1) & (day <= F.dayofmonth(F.last_day(first)))
        start = F.lit("1800-01-01").cast("date")
        n = F.datediff(F.date_add(first, day - 1), start)
        q = feistel(F.floor(n / 773), F.pmod(n, F.lit(773)), F.lit(189), F.lit(773), key, F.lit("date"))
        return F.when(valid, write(F.date_add(start, (q["x"] * 773 + q["y"]).cast("int"))))

    def part(at: int, n: int) -> Column:
        return F.substring(m, at, n).cast("int")
    iso = date(part(1, 4), part(6, 2), part(9, 2), lambda d: F.date_format(d, "yyyy-MM-dd"))
    sep = F.substring(m, 3, 1)
    day_first = date(part(7, 4), part(4, 2), part(1, 2), lambda d: F.concat(
        F.date_format(d, "dd"), sep, F.date_format(d, "MM"), sep, F.date_format(d, "yyyy")))
    return F.coalesce(
        F.when(m.startswith("+"), phone)
        .when(m.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), iso)
        .when(m.rlike(r"^[0-9]{2}[./][0-9]{2}[./][0-9]{4}$"), day_first)
        .otherwise(ip), m)


def _card(shape: Column, digits: Column, key: str) -> Column:
    """``shape`` (with its separators) holding the pseudonym of a valid card."""
    fresh = _pair(F.substring(digits, F.lit(1), F.length(digits) - 1), 10, key, F.lit("card"))
    check = F.pmod(F.lit(10) - F.pmod(_luhn(fresh, True), F.lit(10)), F.lit(10))
    return _refill(shape, F.concat(fresh, check.cast("string")), "0-9")


def replace_cards(docs: DataFrame, col: str, key: str) -> DataFrame:
    """``docs`` with the cards in a text column replaced.

    In every run of digit groups the run itself and all sequences of groups of
    four digits or more (the last: three) with 13-19 digits are tried, so a card
    next to other numbers is found like one by itself.
    Those with a valid check digit are replaced in the order of their first
    place, longer ones first; one that overlaps a replaced one is no longer
    there.  The steps are columns of their own, used twice, so what one has
    found is not computed again for every element of the next."""
    runs, valid, fresh = (free_name(docs, c) for c in ("runs", "valid", "fresh"))
    text = F.col(col)
    out = docs.withColumn(runs, F.when(text.rlike(DIGIT_RUN), F.regexp_extract_all(text, F.lit(DIGIT_RUN), F.lit(0))))

    def checked(run: Column) -> Column:
        found = F.flatten(F.array(*[F.regexp_extract_all(run, F.lit(CARD.format(n - 1)), F.lit(1))
                                    for n in range(13, 20)]))
        return F.filter(F.array_distinct(found), lambda c: (c.rlike(CARD_GROUPS) | (c == run)) & (F.pmod(
            _luhn(F.regexp_replace(c, "[^0-9]", ""), False), F.lit(10)) == 0))
    out = out.withColumn(valid, F.when(F.size(runs) > 0, F.transform(runs, checked)))

    def renamed(cards: Column, run: Column) -> Column:
        return F.transform(cards, lambda c: F.struct(
            F.call_function("instr", run, c).alias("at"),
            (-F.length(c)).alias("less"), c.alias("card"),
            _card(c, F.regexp_replace(c, "[^0-9]", ""), key).alias("new")))
    out = out.withColumn(fresh, F.when(F.size(valid) > 0, F.zip_with(valid, runs, renamed)))

    def written(run: Column, cards: Column) -> Column:
        return F.aggregate(F.sort_array(cards), run, lambda t, c: F.call_function(
            "regexp_replace", t, F.concat(F.lit("(?<![0-9])"), c["card"], F.lit("(?![0-9])")), c["new"]))
    whole = F.array_join(F.zip_with(F.split(text, DIGIT_RUN, -1), F.zip_with(runs, fresh, written),
                                    lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return out.withColumn(col, F.when(F.exists(valid, lambda v: F.size(v) > 0) & (F.size(fresh) > 0), whole)
                          .otherwise(text)).drop(runs, valid, fresh)


def _email(m: Column, key: str) -> Column:
    """The local part (with its @) of an address, permuted chunk by chunk."""
    plain = F.lower(F.regexp_replace(m, "[^A-Za-z0-9]", ""))
    chunks = F.regexp_extract_all(plain, F.lit(".{1,24}"), F.lit(0))
    fresh = F.array_join(F.transform(chunks, lambda c, i: _pair(c, 36, key, F.concat(F.lit("mail"), i.cast("string")))),
                         "")
    return _refill(m, fresh, "A-Za-z0-9")


def _replace(text: Column, pattern: str, fn) -> Column:
    """``text`` with every match of ``pattern`` replaced by ``fn(match)``."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), fn)
    gaps = F.split(text, pattern, -1)
    return F.array_join(F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` (all rows and columns) with personal values in the text permuted."""
    text = F.col(text_col)
    step = free_name(docs, "masked")
    mail = F.when(text.contains("@") & text.rlike(EMAIL), _replace(text, EMAIL, lambda m: _email(m, key))).otherwise(text)
    out = docs.withColumn(step, mail)
    # cards first: they may stand beside dates and other numbers
    out = replace_cards(out, step, key)
    done = F.col(step)
    done = F.when(done.rlike(NUMBERS), _replace(done, NUMBERS, lambda m: pseudonym(m, key))).otherwise(done)
    return out.withColumn(text_col, done).drop(step)


QUERY_NAME = "op9_pii_pseudonyms"
#: Keyed permutations of text spans; tested against a brute-force version.
ORACLE_SQL = None
#: Key of the registered query; real runs pass their own secret.
DEMO_KEY = "demonstration key"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms."""
    docs = open_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, DEMO_KEY)
