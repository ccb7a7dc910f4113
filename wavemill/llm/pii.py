"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

One regular expression finds e-mail addresses and runs of numbers in the whole
text.  In a run every piece from one group of digits (or letters, for IBANs)
to another is a candidate: IBANs, IPv4 addresses, social security numbers
(``ddd-dd-dddd``), dates (``yyyy-mm-dd``, ``yyyy/mm/dd``, ``dd.mm.yyyy``,
``mm/dd/yyyy``), payment card numbers and phone numbers.  A candidate is valid
by its Luhn sum, IBAN remainder, octets under 256, issued number ranges, a real
day between 1700-01-01 and 2138-01-23, or 9 to 15 phone digits.  Of valid
candidates that overlap one is replaced: IBANs first, then cards in their usual
groups, then in text order addresses, security numbers, dates, undivided cards
and phone numbers with a plus, then other cards of 16 digits, other cards and
other phone numbers; of two with one start the longer.  So a number beside a
card (expiry date, card code) does not hide it, a group of digits is never cut,
and anything else stays as it is.

A valid value is permuted by a keyed Feistel network over its own format: each
position keeps its alphabet, check digits are recomputed, separators stay, a
date becomes another real date in the same notation.  The same value under the
same key gets the same pseudonym in every document, however its groups are
divided (cards, IBANs, phone numbers), its date is written or the name of its
e-mail address is capitalised, and two values of a kind never share one.  The domain of an e-mail address stays in
clear as it is written (so an address with its domain in other letters is told
apart), as do the first two digits of a phone number.  (Like any permutation it may map a value to itself; with a
short e-mail name this is a real chance.)

Null text stays null, empty text empty, both without findings.  Rows are
treated one by one, very long texts whole; other columns pass through whatever
their names, except that ``n_pseudonyms`` and ``kinds`` are replaced.  An empty
table gives no rows.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROUNDS = 8
#: Where the key is read from if none is given; there is no built-in one.
KEY_SETTING = "spark.wavemill.pii.key"
#: Keys drawn for applications whose setting holds none.
_DRAWN: dict[str, str] = {}

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
_IP = r"\d{1,3}(?:\.\d{1,3}){3}"
_SSN = r"\d{3}-\d{2}-\d{4}"
_YMD = r"\d{4}([-/])\d{2}\1\d{2}"
_DMY = r"\d{2}\.\d{2}\.\d{4}"
_MDY = r"\d{2}/\d{2}/\d{4}"
_CARD = r"\d(?:[ -]?\d){12,18}"
_PHONE = r"\+\d[\d ().-]{6,18}\d|\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}"
_BEFORE, _AFTER = r"(?<![\w@.+-])", r"(?![\w@]|[.-]\d)"
# a group of digits that neither a word nor an e-mail address goes on with
_GROUP = r"\d++(?![\w@])(?![.%+-][\w.%+-]*+@)"
_MORE = rf"(?:[ ().+/-]++{_GROUP})*+"
_RUN = rf"(?=[+(]?\d(?:[ ().+/-]*+\d){{3}})[+(]?{_GROUP}{_MORE}"
_ANY = rf"(?<![A-Za-z0-9._%+-]){_EMAIL}|{_BEFORE}(?:{_IBAN}{_AFTER}{_MORE}|{_RUN})"
_USUAL = r"^(?:\d{16}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})$"
#: A card has at most as many groups, an IBAN with spaces at most as many characters.
_MOST_GROUPS, _LONGEST = 19, 43


def _let(value: Column, use) -> Column:
    """Bind a value once for several uses."""
    return F.transform(F.array(value), use)[0]


def feistel(values: Column, radices: Column, key: str, tweak: Column) -> Column:
    """Permute an array of numbers, each below the radix at its place."""
    n = F.size(values)
    half = F.floor(n / 2).cast("int")

    def part(a: Column, first: bool) -> Column:
        return F.slice(a, F.lit(1), half) if first else F.slice(a, half + 1, n - half)

    start = F.struct(part(values, True).alias("a"), part(values, False).alias("b"), part(radices, True).alias("ra"), part(radices, False).alias("rb"))

    def turn(s: Column, r: Column) -> Column:
        inner = F.sha2(F.concat_ws("|", F.lit(key), tweak, r.cast("string"), F.array_join(s["b"].cast("array<string>"), ",")), 256)
        pad = F.sha2(F.concat_ws("|", F.lit(key), inner), 256)  # keyed twice, as in HMAC

        def moved(p: Column) -> Column:
            both = F.arrays_zip(s["a"].alias("x"), s["ra"].alias("m"))
            return F.transform(both, lambda z, i: F.pmod(z["x"] + F.pmod(F.xxhash64(p, i), z["m"]), z["m"]))

        return F.struct(s["b"].alias("a"), _let(pad, moved).alias("b"), s["rb"].alias("ra"), s["ra"].alias("rb"))

    assert ROUNDS % 2 == 0
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["a"], s["b"]))


def _longs(*values: Column) -> Column:
    return F.array(*[v.cast("long") for v in values])


def _chars(s: Column) -> Column:
    return F.split(s, "")


def _values(chars: Column) -> tuple[Column, Column]:
    value = F.transform(chars, lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).when(c.rlike("[a-z]"), F.ascii(c) - 97).when(c.rlike("[A-Z]"), F.ascii(c) - 65).otherwise(0).cast("long"))
    radix = F.transform(chars, lambda c: F.when(c.rlike("[0-9]"), 10).when(c.rlike("[a-zA-Z]"), 26).otherwise(1).cast("long"))
    return value, radix


def permuted_text(s: Column, key: str, tweak: str) -> Column:
    """Digits go to digits, letters to letters of the same case; all else stays."""

    def one(chars: Column) -> Column:
        value, radix = _values(chars)
        shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.array_join(chars, ""), "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
        moved = feistel(value, radix, key, F.concat(F.lit(tweak), shape))
        put = lambda c, v: F.when(c.rlike("[0-9]"), F.char(v + 48)).when(c.rlike("[a-z]"), F.char(v + 97)).when(c.rlike("[A-Z]"), F.char(v + 65)).otherwise(c)
        return F.array_join(F.zip_with(chars, moved, put), "")

    return F.when(F.length(s) == 0, s).otherwise(_let(_chars(s), one))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Sum modulo 10 of a digit string whose last digit counts once."""
    n = F.length(digits)

    def add(acc: Column, z: Column) -> Column:
        d = z["d"] * F.when(F.pmod(n - z["i"], F.lit(2)) == 1, 1).otherwise(2)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    marked = F.transform(_chars(digits), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    return F.aggregate(marked, F.lit(0), add, lambda a: a % 10)


def refill(shape: Column, digits: Column, places: str = "[0-9]") -> Column:
    """Put ``digits`` in the places that hold digits (or what ``places`` says) in ``shape``."""
    step = lambda a, c: F.when(c.rlike(places), F.struct(F.concat(a["out"], F.substr(digits, a["k"], F.lit(1))).alias("out"), (a["k"] + 1).alias("k"))).otherwise(
        F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k"))
    )
    return F.aggregate(_chars(shape), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step, lambda a: a["out"])


def _card(s: Column, key: str) -> Column:
    def one(d: Column) -> Column:
        n = F.length(d)
        kept = F.substr(d, F.lit(1), F.lit(1))
        body = F.concat(kept, permuted_text(F.substr(d, F.lit(2), n - 2), key, "card"))
        return _let(body, lambda b: F.concat(b, F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))

    return refill(s, _let(_digits(s), one))


def _phone(s: Column, key: str) -> Column:
    return refill(s, _let(_digits(s), lambda d: F.concat(F.substr(d, F.lit(1), F.lit(2)), permuted_text(F.substr(d, F.lit(3)), key, "phone"))))


def _email(s: Column, key: str) -> Column:
    name = F.substring_index(s, "@", 1)
    cased = lambda new: F.array_join(F.zip_with(_chars(name), _chars(new), lambda c, v: F.when(c.rlike("[A-Z]"), F.upper(v)).otherwise(v)), "")
    moved = _let(permuted_text(F.lower(name), key, "email"), cased)
    return F.concat(F.when(F.length(name) == 0, name).otherwise(moved), F.substr(s, F.length(name) + 1))


def _octets(s: Column) -> Column:
    return F.split(s, "\\.").cast("array<long>")


def _ip(s: Column, key: str) -> Column:
    moved = feistel(_octets(s), F.array_repeat(F.lit(256).cast("long"), 4), key, F.lit("ip"))
    return F.array_join(moved.cast("array<string>"), ".")


def _ssn_parts(s: Column) -> tuple[Column, Column, Column]:
    return tuple(F.substr(s, F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))


def _ssn(s: Column, key: str) -> Column:
    area, group, serial = _ssn_parts(s)
    # 001-899 without 666: 898 areas
    values = _longs(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1)
    moved = feistel(values, _longs(F.lit(898), F.lit(99), F.lit(9999)), key, F.lit("ssn"))
    put = lambda m: F.concat_ws("-", F.lpad((m[0] + F.when(m[0] >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((m[1] + 1).cast("string"), 2, "0"), F.lpad((m[2] + 1).cast("string"), 4, "0"))
    return _let(moved, put)


#: Dates are numbered from 1700-01-01; 400 * 400 of them.
_FIRST, _SIDE = "1700-01-01", 400


def _day(s: Column) -> Column:
    """The calendar day that a text in one of the notations names, null if none."""
    sub = lambda a, n: F.substr(s, F.lit(a), F.lit(n))
    iso = F.when(s.rlike(f"^{_YMD}$"), F.concat_ws("-", sub(1, 4), sub(6, 2), sub(9, 2)))
    iso = iso.when(s.rlike(f"^{_DMY}$"), F.concat_ws("-", sub(7, 4), sub(4, 2), sub(1, 2))).when(s.rlike(f"^{_MDY}$"), F.concat_ws("-", sub(7, 4), sub(1, 2), sub(4, 2)))
    return iso.try_cast("date")


def _offset(s: Column) -> Column:
    return F.datediff(_day(s), F.lit(_FIRST).cast("date"))


def _date(s: Column, key: str) -> Column:
    def one(n: Column) -> Column:
        moved = feistel(_longs(F.floor(n / _SIDE), F.pmod(n, F.lit(_SIDE))), _longs(F.lit(_SIDE), F.lit(_SIDE)), key, F.lit("date"))
        return _let(moved, lambda m: F.date_add(F.lit(_FIRST).cast("date"), (m[0] * _SIDE + m[1]).cast("int")).cast("string"))

    def put(d: Column) -> Column:
        y, m, t = (F.substr(d, F.lit(a), F.lit(n)) for a, n in ((1, 4), (6, 2), (9, 2)))
        return F.when(s.rlike(f"^{_DMY}$"), F.concat_ws(".", t, m, y)).when(s.rlike(f"^{_MDY}$"), F.concat_ws("/", m, t, y)).otherwise(F.concat(y, F.substr(s, F.lit(5), F.lit(1)), m, F.substr(s, F.lit(5), F.lit(1)), t))

    return _let(_let(_offset(s).cast("long"), one), put)


def _remainder97(s: Column) -> Column:
    def add(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), F.pmod(acc * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(acc * 100 + F.ascii(c) - 55, F.lit(97)))

    return F.aggregate(_chars(s), F.lit(0), lambda a, c: add(a, c).cast("int"))


def _iban_rest(s: Column) -> Column:
    bare = F.replace(s, F.lit(" "), F.lit(""))
    return F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))


def _iban(s: Column, key: str) -> Column:
    country, bare = F.substr(s, F.lit(1), F.lit(2)), F.replace(s, F.lit(" "), F.lit(""))
    body = permuted_text(F.substr(bare, F.lit(5)), key, "iban")
    check = lambda b: F.concat(country, F.lpad((98 - _remainder97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b)
    return _let(_let(body, check), lambda new: refill(s, new, "[0-9A-Z]"))


def kind_of(s: Column) -> Column:
    """The kind of a candidate if it is valid, else null."""
    area, group, serial = _ssn_parts(s)
    digits = F.length(_digits(s))
    day = _offset(s)
    return (
        F.when(s.contains("@"), "email")
        .when(s.rlike("^[A-Z]"), F.when(F.length(F.replace(s, F.lit(" "), F.lit(""))).between(15, 34) & F.substr(s, F.lit(3), F.lit(2)).between("02", "98") & (_remainder97(_iban_rest(s)) == 1), "iban"))
        .when(s.rlike(f"^{_IP}$"), F.when(~F.exists(_octets(s), lambda o: o > 255), "ip"))
        .when(s.rlike(f"^{_SSN}$"), F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), "ssn"))
        .when(s.rlike(f"^(?:{_YMD}|{_DMY}|{_MDY})$"), F.when(day.between(0, _SIDE * _SIDE - 1), "date"))
        .when(s.rlike(f"^{_CARD}$") & digits.between(13, 19) & (luhn_sum(_digits(s)) == 0), "card")
        .when(s.rlike(f"^(?:{_PHONE})$") & digits.between(9, 15), "phone")
    )


def pseudonym(s: Column, kind: Column, key: str) -> Column:
    out = F.when(kind == "email", _email(s, key)).when(kind == "iban", _iban(s, key)).when(kind == "ip", _ip(s, key))
    return out.when(kind == "ssn", _ssn(s, key)).when(kind == "date", _date(s, key)).when(kind == "card", _card(s, key)).when(kind == "phone", _phone(s, key)).otherwise(s)


def _candidates(units: Column, tokens: Column, gaps: Column) -> Column:
    """The valid candidates of a run: ``rank, i, less, e, kind, text, signed`` from group ``i`` to ``e``, in order of choice."""
    n = F.size(tokens)

    def judged(i: Column, e: Column, s: Column, signed: bool) -> Column:
        before, after = gaps[i], gaps[e + 1]
        start = ((i == 0) | before.rlike(r"[^.+-][+(]$")) if signed else ~before.rlike(r"[.+-]$")
        strict = start & ~after.isin(".", "-")
        loose = F.lit(False) if signed else ~before.rlike(r"[.+]$") & (after != ".")

        def ranked(k: Column) -> Column:
            usual, whole = s.rlike(_USUAL), s.rlike(r"^\d+$")
            card = F.when(usual, 1).when(whole, 2).when(F.length(_digits(s)) == 16, 3).otherwise(4)
            rank = F.when(k == "iban", F.when(s.rlike(f"^{_IBAN}$"), 0)).when(k == "card", card).when(k == "phone", F.when(s.startswith("+"), 2).otherwise(5)).otherwise(2)
            fits = F.when(k == "card", loose).otherwise(strict) & k.isNotNull() & rank.isNotNull()
            return F.when(fits, F.struct(rank.alias("rank"), i.alias("i"), (-F.length(s)).alias("less"), e.alias("e"), k.alias("kind"), s.alias("text"), F.lit(signed).alias("signed")))

        return _let(F.when(strict | loose, kind_of(s)), ranked)

    def piece(i: Column, e: Column) -> Column:
        def both(s: Column) -> Column:
            sign = F.right(gaps[i], F.lit(1))
            signed = F.when(sign.isin("+", "("), _let(F.concat(sign, s), lambda x: judged(i, e, x, True)))
            return F.when(F.length(s).between(7, _LONGEST), F.array(judged(i, e, s, False), signed)).otherwise(F.array())

        return _let(F.concat(tokens[i], F.array_join(F.slice(units, i + 2, e - i), "")), both)

    ends = lambda i: F.flatten(F.transform(F.sequence(i, F.least(i + _MOST_GROUPS - 1, n - 1)), lambda e: piece(i, e)))
    every = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), ends))
    return F.array_sort(F.filter(every, lambda c: c.isNotNull()))


def _treated_run(run: Column, key: str) -> Column:
    """``kinds`` and ``new`` text of a run of numbers."""
    word = "[A-Za-z0-9]+"

    def split(x: Column) -> Column:
        tokens, gaps, units = x["tokens"], x["gaps"], x["units"]
        kind = "array<struct<rank:int,i:int,less:int,e:int,kind:string,text:string,signed:boolean>>"

        def choose(acc: Column, c: Column) -> Column:
            return F.when(F.exists(acc, lambda a: (a["i"] <= c["e"]) & (c["i"] <= a["e"])), acc).otherwise(F.concat(acc, F.array(c)))

        chosen = F.aggregate(_candidates(units, tokens, gaps), F.array().cast(kind), choose)
        ordered = F.array_sort(F.transform(chosen, lambda c: F.struct(c["i"].alias("i"), c["e"].alias("e"), c["kind"].alias("kind"), c["text"].alias("text"), c["signed"].alias("signed"))))

        def put(acc: Column, c: Column) -> Column:
            gap = F.when(c["signed"], F.left(gaps[c["i"]], F.length(gaps[c["i"]]) - 1)).otherwise(gaps[c["i"]])
            between = F.array_join(F.slice(units, acc["at"] + 1, c["i"] - acc["at"]), "")
            return F.struct((c["e"] + 1).alias("at"), F.concat(acc["out"], between, gap, pseudonym(c["text"], c["kind"], key)).alias("out"))

        def finished(found: Column) -> Column:
            end = lambda a: F.concat(a["out"], F.array_join(F.slice(units, a["at"] + 1, F.size(units)), ""), gaps[F.size(units)])
            new = F.aggregate(found, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put, end)
            return F.struct(F.transform(found, lambda c: c["kind"]).alias("kinds"), new.alias("new"))

        return _let(ordered, finished)

    tokens, gaps = F.regexp_extract_all(run, F.lit(word), F.lit(0)), F.split(run, word, -1)
    parts = lambda p: F.struct(p["tokens"].alias("tokens"), p["gaps"].alias("gaps"), F.zip_with(F.slice(p["gaps"], F.lit(1), F.size(p["tokens"])), p["tokens"], lambda g, t: F.concat(g, t)).alias("units"))
    return _let(_let(F.struct(tokens.alias("tokens"), gaps.alias("gaps")), parts), split)


def key_of(spark: SparkSession) -> str | None:
    """The key that the session's setting names, if any."""
    return spark.conf.get(KEY_SETTING, None) or spark.sparkContext.getConf().get(KEY_SETTING)


def application_key(spark: SparkSession) -> str:
    """The setting's key or else one drawn at random, which the driver keeps in memory as long as the application runs.

    Under a drawn key values stay linked within the application, and nobody can
    link them afterwards; to link runs, set the key.
    """
    return key_of(spark) or _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def pseudonymise(docs: DataFrame, key: str | None = None, text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` with the text pseudonymised, ``n_pseudonyms long`` and ``kinds array<string>``, in text order.

    Without ``key`` the setting ``spark.wavemill.pii.key`` must hold one.
    """
    key = key or key_of(docs.sparkSession)
    if not key:
        raise ValueError(f"no key: pass one or set {KEY_SETTING}")
    text = F.col(text_col)
    docs = docs.drop("n_pseudonyms", "kinds")
    names = docs.columns
    maybe = text.rlike("[0-9@]")
    found = F.when(maybe, F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)))

    def treat(m: Column) -> Column:
        return F.when(m.contains("@"), F.struct(F.array(F.lit("email")).alias("kinds"), pseudonym(m, F.lit("email"), key).alias("new"))).otherwise(_treated_run(m, key))

    taken, found_col, new_col = {c.lower() for c in names}, "_found", "_new"
    while found_col in taken or new_col in taken:
        found_col, new_col = "_" + found_col, "_" + new_col
    marked = docs.withColumn(found_col, found).withColumn(new_col, F.when(F.size(found_col) > 0, F.transform(found_col, treat)))
    hit = F.coalesce(F.exists(new_col, lambda x: F.size(x["kinds"]) > 0), F.lit(False))
    rest = F.split(text, _ANY, -1)
    joined = F.array_join(F.zip_with(rest, F.transform(new_col, lambda x: x["new"]), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    kinds = F.coalesce(F.flatten(F.transform(new_col, lambda x: x["kinds"])), F.array().cast("array<string>"))
    new_text = F.when(hit, joined).otherwise(text).alias(text_col)
    return marked.select(*[new_text if c == text_col else F.col(c) for c in names], F.size(kinds).cast("long").alias("n_pseudonyms"), kinds.alias("kinds"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), application_key(spark))
