"""Personal data: format-preserving Feistel pseudonyms.

Numbers and dates that pass their validation are permuted under a key within their own format, so
equal values stay equal in every document, different values stay different, and the key's holder can
turn them back (``reverse``):

* payment cards (13 to 19 digits, also in fours, or 4-6-5): Luhn-valid ones; the check digit is made anew;
* IBANs, also in groups of four: those with the right remainder; all digits behind the check digits are permuted, letters
  are shifted by a digest of the new digits; country and places of letters stay, check digits are made anew;
* phone numbers with a country code, or of ten digits as (ddd) ddd-dddd, ddd-ddd-dddd or ddd.ddd.dddd: those ten digits.
  Numbers of other groupings, or without any sign between the digits, are not taken for phones;
* social security numbers: without impossible parts;
* IPv4 addresses: as 32 bits;
* dates: real days of 1900-01-01 to 2101-01-27.  Year-month-day and month/day/year ones are permuted among all days.  A
  slash date whose first part is over 12 can only be day/month/year; such dates are permuted among themselves (the
  permutation is applied until it gives a day over 12 again), so that the new date reads the same way.

E-mail addresses become ``user<keyed digest>@example.invalid``, equal ones alike.  Everything else,
also numbers that fail their check, stays as it is.

The key reaches the tasks as a scalar subquery and stands in no plan, explain() or event log.

The permutation is an alternating Feistel network of ``ROUNDS`` rounds over two halves with keyed
SHA-256 as round function; halves of unequal size keep any number of digits in its domain.  Only
DataFrame functions, one pass, no shuffle.

Edge cases: a null text stays null with zero counts; empty texts stay; all other columns of the input
are kept, whatever their names, and a count column that the input already has is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import unused

ROUNDS = 8
DAYS = 271  # dates: 271 * 271 days
#: Steps after which a day over 12 is met but once in 10 ** 25 keys and dates (the date then stays as it is).
WALK = 64
FIRST_DAY = "1900-01-01"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
PHONE = (r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
         r"|(?<![0-9+(.-])(?:\([0-9]{3}\) ?[0-9]{3}[.-][0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4})(?![0-9]|[.-][0-9])")
DATE = r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
KINDS = ("email", "iban", "phone", "date", "ssn", "ip", "card")
ANY = "|".join((EMAIL, IBAN, PHONE, DATE, SSN, IP, CARD))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _keyed(key: str | Column, *parts: Column) -> Column:
    """A number below 16 ** 15 from the key and the parts."""
    text = F.concat_ws("|", F.lit(key) if isinstance(key, str) else key, *parts)
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str | Column, kind: str, reverse: bool = False) -> Column:
    """Struct (a, b): the keyed permutation of the pairs below (size_a, size_b), or its inverse."""
    def mixed(i, x, size):
        return F.pmod(_keyed(key, F.lit(kind), size_a.cast("string"), size_b.cast("string"), i.cast("string"), x.cast("string")), size)

    def step(s, i):
        sign = -1 if reverse else 1
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["a"] + sign * mixed(i, s["b"], size_a), size_a)).otherwise(s["a"]).alias("a"),
            F.when(~even, F.pmod(s["b"] + sign * mixed(i, s["a"], size_b), size_b)).otherwise(s["b"]).alias("b"))
    rounds = [F.lit(i) for i in (reversed(range(ROUNDS)) if reverse else range(ROUNDS))]
    return F.aggregate(F.array(*rounds), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), step)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("bigint")


def permuted_digits(d: Column, key: str, kind: str, reverse: bool) -> Column:
    """The digits of a string of 2 to 20 digits, permuted among those of its length."""
    n = F.length(d)
    u = F.floor(n / 2).cast("int")
    out = feistel(d.substr(F.lit(1), u), d.substr(u + 1, n), _power(u), _power(n - u), key, kind, reverse)
    return F.transform(F.array(out), lambda s: F.concat(
        F.lpad(s["a"].cast("string"), u, "0"), F.lpad(s["b"].cast("string"), n - u, "0")))[0]


def _into_format(m: Column, d: Column) -> Column:
    """The digits ``d`` in the places of the digits of ``m``."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(
        m.substr(i, F.lit(1)).rlike("[0-9]"), d.substr(F.length(_digits(m.substr(F.lit(1), i))), F.lit(1))).otherwise(m.substr(i, F.lit(1)))), "")


def luhn_sum(d: Column, shift: int) -> Column:
    """Luhn sum of the digits; ``shift`` 1: every second digit from the last counts twice, from the last itself."""
    n = F.length(d)

    def add(acc, i):
        x = d.substr(n - i + 1, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return acc + F.when((i + shift) % 2 == 0, twice).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _mod97(d: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda r, i: (r * 10 + d.substr(i, F.lit(1)).cast("int")) % 97)


def _letters_out(c: Column) -> Column:
    """Letters as two digits (A: 10), as the remainder of an IBAN reads them."""
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x.rlike("[A-Z]"), (F.ascii(x) - 55).cast("string")).otherwise(x)), "")


def _once(c: Column, make) -> Column:
    """``make`` of a value that is worked out once."""
    return F.transform(F.array(c), make)[0]


def _card(m, key, reverse):
    d = _digits(m)
    body = permuted_digits(d.substr(F.lit(1), F.length(d) - 1), key, "card", reverse)
    done = F.transform(F.array(body), lambda x: F.concat(x, ((10 - luhn_sum(x, 1) % 10) % 10).cast("string")))[0]
    return F.when(luhn_sum(d, 0) % 10 == 0, _into_format(m, done))


def _iban(m, key, reverse):
    flat = F.regexp_replace(m, " ", "")
    country, account = flat.substr(F.lit(1), F.lit(2)), flat.substr(F.lit(5), F.length(flat))
    digits = F.regexp_replace(account, "[^0-9]", "")
    half = F.when(F.length(digits) > 18, F.floor(F.length(digits) / 2).cast("int")).otherwise(F.length(digits))

    def permuted(part, kind):
        return F.when(F.length(part) > 1, permuted_digits(part, key, kind, reverse)).otherwise(part)
    new = F.concat(permuted(digits.substr(F.lit(1), half), "iban"), permuted(digits.substr(half + 1, F.length(digits)), "iban2"))

    def told(x):  # letters are shifted by the permuted digits: those found when turning back
        sign, secret = (-1, digits) if reverse else (1, x)

        def letter(i):
            c = account.substr(i, F.lit(1))
            shifted = F.pmod(F.ascii(c) - 65 + sign * _keyed(key, F.lit("iban3"), secret, i.cast("string")), F.lit(26).cast("bigint"))
            at = F.length(F.regexp_replace(account.substr(F.lit(1), i), "[^0-9]", ""))
            return F.when(c.rlike("[A-Z]"), F.chr(shifted + 65)).otherwise(x.substr(at, F.lit(1)))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(account)), letter), "")

    def checked(x):
        check = F.lpad((98 - _mod97(_letters_out(F.concat(x, country, F.lit("00"))))).cast("string"), 2, "0")
        return F.concat(country, check, x)

    def spaced(x):
        at = lambda i: F.length(F.regexp_replace(m.substr(F.lit(1), i), " ", ""))
        return F.when(m.contains(" "), F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(
            m.substr(i, F.lit(1)) == " ", " ").otherwise(x.substr(at(i), F.lit(1)))), "")).otherwise(x)
    done = _once(_once(_once(new, told), checked), spaced)
    valid = (_mod97(_letters_out(F.concat(account, country, flat.substr(F.lit(3), F.lit(2))))) == 1) & flat.substr(F.lit(3), F.lit(2)).between("02", "98")
    return F.when(valid, done)


def _phone(m, key, reverse):
    d = _digits(m)
    code = F.length(d) - 10
    return _into_format(m, F.concat(d.substr(F.lit(1), code), permuted_digits(d.substr(code + 1, F.lit(10)), key, "phone", reverse)))


def _ssn(m, key, reverse):
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999, permuted among themselves."""
    part = lambda at, n: m.substr(F.lit(at), F.lit(n)).cast("bigint")
    area = part(1, 3) - 1 - (part(1, 3) > 666).cast("bigint")
    out = feistel(area * 99 + part(5, 2) - 1, part(8, 4) - 1, F.lit(898 * 99).cast("bigint"), F.lit(9999).cast("bigint"),
                  key, "ssn", reverse)
    new = F.transform(F.array(out), lambda s: F.concat_ws(
        "-", F.lpad((F.floor(s["a"] / 99) + 1 + (F.floor(s["a"] / 99) >= 665).cast("bigint")).cast("string"), 3, "0"),
        F.lpad((s["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((s["b"] + 1).cast("string"), 4, "0")))[0]
    return F.when(~m.rlike("^(000|666|9)|-00-|-0000$"), new)


def _ip(m, key, reverse):
    part = lambda k: F.split(m, r"\.")[k].cast("bigint")
    size = F.lit(65536).cast("bigint")
    out = feistel(part(0) * 256 + part(1), part(2) * 256 + part(3), size, size, key, "ip", reverse)
    return F.transform(F.array(out), lambda s: F.concat_ws(".", *(
        F.floor(s[h] / 256).cast("string") if k == 0 else (s[h] % 256).cast("string") for h in "ab" for k in (0, 1))))[0]


def _date(m, key, reverse):
    first, size = F.lit(FIRST_DAY).cast("date"), F.lit(DAYS).cast("bigint")
    known = lambda day: day.between(0, DAYS * DAYS - 1)

    def days(form):
        return F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), first)

    def permuted(day):
        return _once(feistel(F.floor(day / DAYS), day % DAYS, size, size, key, "date", reverse), lambda s: (s["a"] * DAYS + s["b"]).cast("int"))

    def any_day(form):
        return F.when(known(days(form)), F.date_format(F.date_add(first, permuted(days(form))), form))

    def late_day(form):
        """Again and again, until the day is over 12; 3 in 5 days are."""
        def again(s, _):
            nxt = _once(permuted(s["day"]), lambda x: F.struct(x.alias("day"), (F.dayofmonth(F.date_add(first, x)) > 12).alias("done")))
            return F.when(s["done"], s).otherwise(nxt)
        begin = F.struct(days(form).alias("day"), F.lit(False).alias("done"))
        return F.when(known(days(form)), _once(F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), begin, again), lambda s: F.when(
            s["done"], F.date_format(F.date_add(first, s["day"]), form))))
    return F.when(m.contains("-"), any_day("yyyy-MM-dd")).when(m.substr(F.lit(1), F.lit(2)) <= "12", any_day("MM/dd/yyyy")).otherwise(late_day("dd/MM/yyyy"))


def _email(m, key):
    return F.concat(F.lit("user"), F.substring(F.sha2(F.concat_ws("|", key, F.lit("email"), F.lower(m)), 256), 1, 16),
                    F.lit("@example.invalid"))


def _kind(m: Column) -> Column:
    return (F.when(m.contains("@"), "email").when(m.rlike("^[A-Z]"), "iban").when(m.rlike(f"^(?:{PHONE})$"), "phone")
            .when(m.rlike(f"^(?:{IP})$"), "ip").when(m.rlike(f"^(?:{DATE})$"), "date").when(m.rlike(f"^(?:{SSN})$"), "ssn").otherwise("card"))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", reverse: bool = False) -> DataFrame:
    """The input with its text rewritten and, as bigint, ``n_email``, ``n_iban``, ... and ``n_private`` (all):
    the values replaced.  ``reverse`` turns permuted values back (e-mail addresses cannot be)."""
    secret, found = unused(docs, "secret"), unused(docs, "found")
    keyed = docs.sparkSession.createDataFrame([(key,)], "key string")
    key_col = F.col(secret)

    def replaced(m):
        kind = _kind(m)
        cases = {"iban": _iban, "phone": _phone, "date": _date, "ssn": _ssn, "ip": _ip, "card": _card}
        new = F.lit(None).cast("string") if reverse else F.when(kind == "email", _email(m, key_col))
        for name, make in cases.items():
            new = F.coalesce(new, F.when(kind == name, make(m, key_col, reverse)))
        return F.struct(kind.alias("kind"), m.alias("old"), new.alias("new"))

    text, hits = F.col(text_col), F.col(found)
    none = F.lit(None).cast("array<struct<kind:string,old:string,new:string>>")
    out = docs.withColumn(secret, keyed.scalar())
    out = out.withColumn(found, F.when(text.rlike(ANY), F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), replaced)).otherwise(none))
    joined = F.array_join(F.transform(F.split(text, ANY, -1), lambda r, i: F.concat(
        r, F.coalesce(F.get(hits, i)["new"], F.get(hits, i)["old"], F.lit("")))), "")

    def number(kind):
        return F.size(F.filter(hits, lambda x: (x["kind"] == kind) & x["new"].isNotNull())).cast("bigint")
    counts = {f"n_{kind}": F.when(hits.isNull(), F.lit(0).cast("bigint")).otherwise(number(kind)) for kind in KINDS}
    out = out.withColumns({text_col: F.when(hits.isNull(), text).otherwise(joined), **counts}).drop(found, secret)
    return out.withColumn("n_private", sum((F.col(k) for k in list(counts)[1:]), F.col("n_email")))
