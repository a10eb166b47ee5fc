"""Format-preserving pseudonyms for personal data, in DataFrame functions only (operator 3).

Values are found by one pattern, classified and validated, and replaced inside
their own format by a keyed Feistel permutation, so equal values get equal
pseudonyms in every document, different ones different pseudonyms:

* ``card``: 13 to 19 digits, plain or in groups.  All but the last digit are permuted; the last one
  keeps its distance from the Luhn check digit, so valid numbers stay valid.
* ``iban``: two letters, two check digits, country body that passes mod 97, plain or in groups of four
  of the country's length.  Digits of the body are permuted and the check digits recomputed.
* ``ssn``: ddd-dd-dddd; all digits permuted.
* ``phone``: international number with ``+``; the digits after the country code are permuted, so one
  number has one pseudonym however it is spaced.  ``(ddd) ddd-dddd`` and ``ddd-ddd-dddd``, with or without
  a leading 1, are numbers of country 1 and linked with their international form.  Other national
  numbers start with 0: the digits after it are permuted, unlinked with a form that names the country.
* ``ipv4``: four octets up to 255, permuted as 32 bits.
* ``date``: valid days of 1900 to 2099 as yyyy-mm-dd, dd.mm.yyyy or dd/mm/yyyy, permuted among those days.
* ``email``: letters and digits of the local part are permuted, case, marks and domain stay.
* ``secret``: 32 to 128 hexadecimal digits, permuted as such.

What fails validation (an octet of 300, a 13th month) is left as it stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
_IN, _OUT = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: Length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
    31: "MT SC", 32: "LC", 33: "RU",
}
#: Country calling codes of one and of two digits; all others have three.
CALLING_CODE = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"


def _grouped_iban() -> str:
    """IBANs in groups of four, the last one as long as the country's length leaves it."""
    forms = []
    for length, countries in IBAN_LENGTHS.items():
        full, rest = divmod(length - 4, 4)
        last = f" [A-Z0-9]{{{rest}}}" if rest else ""
        forms.append(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{full}}}{last}")
    return "(?:" + "|".join(forms) + ")"


#: National numbers of country 1, and those of other countries, whose leading 0 is no part of them.
_NATIONAL = r"(?:1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}"
_TRUNK = r"0[0-9]{2,4}[ /-](?:[0-9]{6,8}|[0-9]{3,4}[ -][0-9]{3,4})"
#: Tried in this order at every place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}" + _OUT,
    "national": rf"(?<![0-9A-Za-z+.-])(?:{_NATIONAL}|{_TRUNK})(?![0-9A-Za-z]|[ .-][0-9])",
    "iban": _IN + r"(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|" + _grouped_iban() + ")" + _OUT,
    "secret": _IN + r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})" + _OUT,
    "date": _IN + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})" + _OUT,
    "ssn": _IN + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _OUT,
    "ipv4": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "card": _IN + r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + _OUT,
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
FIRST_DAY, N_DAYS = "1900-01-01", 73049
#: 73049 days of 1900 to 2099 = 17 * 4297, the two halves of their permutation.
_DAY_HIGH, _DAY_LOW = 17, 4297


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once (an expression named in a lambda is computed per element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _digits(s: Column) -> Column:
    """Digits of a string as an array of numbers (hexadecimal letters included if there are any)."""
    return F.transform(_chars(s), lambda c: F.conv(c, 16, 10).cast("int"))


def _noise(key: str, tweak: Column, i: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), F.array_join(half.cast("array<string>"), ",")), 512)


def permute(values: Column, radix: int, key: str, tweak: Column) -> Column:
    """Feistel permutation of an array of numbers below ``radix`` (up to 128 of them).

    The halves swap ``ROUNDS`` times; each time the left one is shifted, digit by digit, by a keyed
    hash of the right one.  A single digit is shifted by a keyed constant.
    """
    def shift(half, noise):
        return let(noise, lambda x: F.transform(half, lambda v, j: (
            (v + F.conv(F.substr(x, j * 2 + 1, F.lit(2)), 16, 10).cast("int")) % radix).cast("int")))

    def turn(v):
        n = F.size(v)
        name = F.concat_ws("|", tweak, F.lit(str(radix)), n.cast("string"))
        half = (n / 2).cast("int")
        start = F.struct(F.slice(v, F.lit(1), half).alias("a"), F.slice(v, half + 1, n - half).alias("b"))
        done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, i: F.struct(
            s["b"].alias("a"), shift(s["a"], _noise(key, name, i, s["b"])).alias("b")),
            lambda s: F.concat(s["a"], s["b"]))
        one = shift(v, _noise(key, name, F.lit(0), F.slice(v, 1, 0)))
        return F.when(n < 2, one).otherwise(done)

    return let(values, turn)


def _refill(s: Column, wanted: str, new: Column, skip: Column | int = 0) -> Column:
    """``s`` with its characters of class ``wanted``, after the first ``skip`` of them, replaced in order."""
    start = F.struct(F.lit("").alias("s"), (-F.lit(skip) if isinstance(skip, int) else -skip).alias("k"))
    return let(new, lambda v: F.aggregate(_chars(s), start, lambda acc, c: F.struct(
        F.concat(acc["s"], F.when(c.rlike(wanted) & (acc["k"] >= 0), F.coalesce(F.get(v, acc["k"]), c)).otherwise(c)).alias("s"),
        (acc["k"] + F.when(c.rlike(wanted), 1).otherwise(0)).alias("k")), lambda acc: acc["s"]))


def _luhn_digit(digits: Column) -> Column:
    """The digit that makes ``digits`` followed by it pass the Luhn check."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, j: F.when((n - j) % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda s, d: s + d), F.lit(10))


def _strings(values: Column, radix: int = 10) -> Column:
    return F.transform(values, lambda v: F.lower(F.conv(v.cast("string"), 10, radix)))


def _card(m: Column, key: str) -> Column:
    def with_check(d, head, new):
        last = F.pmod(F.element_at(d, -1) - _luhn_digit(head) + _luhn_digit(new), F.lit(10)).cast("int")
        return _refill(m, "[0-9]", _strings(F.concat(new, F.array(last))))

    return let(_digits(F.regexp_replace(m, "[^0-9]", "")), lambda d: let(
        F.slice(d, F.lit(1), F.size(d) - 1), lambda head: let(
            permute(head, 10, key, F.lit("card")), lambda new: with_check(d, head, new))))


def _mod97(s: Column) -> Column:
    """Remainder of an IBAN's rearranged string, letters counting from 10."""
    return F.aggregate(_chars(s), F.lit(0), lambda r, c: (
        F.when(c.rlike("[0-9]"), r * 10 + c.try_cast("int")).otherwise(r * 100 + F.ascii(c) - 55) % 97).cast("int"))


def iban_valid(m: Column) -> Column:
    return _mod97(F.concat(F.substring(m, 5, 40), F.substring(m, 1, 4))) == 1


def _compact(m: Column) -> Column:
    return F.regexp_replace(m, " ", "")


def _iban(m: Column, key: str) -> Column:
    def renewed(plain):
        body, country = F.substring(plain, 5, 40), F.substring(plain, 1, 2)
        digits = _digits(F.regexp_replace(body, "[^0-9]", ""))
        check = lambda new: (98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string")
        return let(_refill(body, "[0-9]", _strings(permute(digits, 10, key, country))),
                   lambda new: F.concat(country, F.lpad(check(new), 2, "0"), new))

    return let(_compact(m), lambda plain: _refill(m, "[A-Z0-9]", _chars(renewed(plain))))


def _octets(m: Column) -> Column:
    return F.transform(F.split(m, r"\."), lambda o: o.try_cast("int"))


def ipv4_valid(m: Column) -> Column:
    return F.forall(_octets(m), lambda o: o <= 255)


def _ipv4(m: Column, key: str) -> Column:
    nibbles = F.flatten(F.transform(_octets(m), lambda o: F.array((o / 16).cast("int"), o % 16)))
    return let(permute(nibbles, 16, key, F.lit("ipv4")), lambda new: F.array_join(F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda i: (F.get(new, i * 2) * 16 + F.get(new, i * 2 + 1)).cast("string")), "."))


def _iso(m: Column) -> Column:
    day_first = F.concat(F.substring(m, 7, 4), F.lit("-"), F.substring(m, 4, 2), F.lit("-"), F.substring(m, 1, 2))
    return F.when(F.substring(m, 5, 1) == "-", m).otherwise(day_first)


def _day(m: Column) -> Column:
    """Days since ``FIRST_DAY``; null if the string is no day of 1900 to 2099."""
    n = F.date_diff(_iso(m).try_cast("date"), F.lit(FIRST_DAY).cast("date"))
    return F.when((n >= 0) & (n < N_DAYS), n)


def _date(m: Column, key: str) -> Column:
    start = F.struct((_day(m) / _DAY_LOW).cast("int").alias("h"), (_day(m) % _DAY_LOW).alias("l"))

    def add(v, noise, size):
        return ((v + F.conv(F.substring(noise, 1, 7), 16, 10).cast("int")) % size).cast("int")

    def turn(s, i):
        return let(add(s["h"], _noise(key, F.lit("day"), i, F.array(s["l"])), _DAY_HIGH), lambda high: F.struct(
            high.alias("h"), add(s["l"], _noise(key, F.lit("day"), -i, F.array(high)), _DAY_LOW).alias("l")))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["h"] * _DAY_LOW + s["l"])
    mark = F.substring(m, 3, 1)
    return let(F.date_add(F.lit(FIRST_DAY).cast("date"), done), lambda new: F.when(
        F.substring(m, 5, 1) == "-", F.date_format(new, "yyyy-MM-dd")).otherwise(
        F.concat(F.date_format(new, "dd"), mark, F.date_format(new, "MM"), mark, F.date_format(new, "yyyy"))))


def _email(m: Column, key: str) -> Column:
    local, domain = F.split_part(m, F.lit("@"), F.lit(1)), F.split_part(m, F.lit("@"), F.lit(2))
    letters = F.transform(_chars(F.lower(F.regexp_replace(local, "[^A-Za-z]", ""))), lambda c: F.ascii(c) - 97)
    digits = _digits(F.regexp_replace(local, "[^0-9]", ""))
    # letters are keyed by the address's shape, digits also by the letters
    shape = F.lower(F.concat(F.regexp_replace(F.regexp_replace(local, "[0-9]", "9"), "[A-Za-z]", "a"), F.lit("@"), domain))
    named = F.concat(F.lower(F.regexp_replace(local, "[0-9]", "9")), F.lit("@"), F.lower(domain))
    small = F.transform(permute(letters, 26, key, F.concat(F.lit("email"), shape)), lambda v: F.char(v + 97))
    number = _strings(permute(digits, 10, key, named))
    case = lambda n, o: F.when(o.rlike("[A-Z]"), F.upper(n)).otherwise(n)
    cased = F.array_join(F.zip_with(_chars(_refill(local, "[A-Za-z]", small)), _chars(local), case), "")
    return F.concat(_refill(cased, "[0-9]", number), F.lit("@"), domain)


def _phone(m: Column, key: str) -> Column:
    """Only the digits decide: those of the country code stay, the others are permuted."""
    def renewed(d, country, shown):
        new = permute(F.slice(_digits(d), shown + 1, F.length(d)), 10, key, F.concat(F.lit("phone"), country))
        return _refill(m, "[0-9]", _strings(new), shown)

    def turn(d):
        abroad = F.regexp_extract(d, f"^(?:{CALLING_CODE})", 0)
        at_home = m.rlike(f"^{_NATIONAL}$")
        country = F.when(m.startswith("+"), abroad).when(at_home, "1").otherwise("0")
        # a national number of country 1 may leave the code out
        shown = F.when(at_home, F.length(d) - 10).otherwise(F.length(country))
        return let(country, lambda c: renewed(d, c, shown))

    return let(F.regexp_replace(m, "[^0-9]", ""), turn)


def _whole(m: Column, key: str, radix: int, name: str) -> Column:
    wanted = "[0-9]" if radix == 10 else "[0-9A-Fa-f]"
    d = _digits(F.regexp_replace(m, f"[^{wanted[1:]}", ""))
    return let(_refill(m, wanted, _strings(permute(d, radix, key, F.lit(name)), radix)),
               lambda new: F.when(m.rlike("[A-F]"), F.upper(new)).otherwise(new))


def kind_of(m: Column) -> Column:
    """Kind of a match, null if it fails validation.  The order is that of ``PATTERNS``."""
    is_ = lambda k: m.rlike(f"^(?:{PATTERNS[k]})$")
    return (F.when(m.contains("@"), "email").when(m.startswith("+") | is_("national"), "phone")
            .when(is_("iban") & iban_valid(_compact(m)), "iban").when(is_("secret"), "secret")
            .when(is_("date"), F.when(_day(m).isNotNull(), F.lit("date")))
            .when(is_("ssn"), "ssn").when(is_("ipv4"), F.when(ipv4_valid(m), F.lit("ipv4")))
            .when(is_("card"), "card"))


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    return F.coalesce(
        F.when(kind == "email", _email(m, key)).when(kind == "phone", _phone(m, key)).when(kind == "iban", _iban(m, key))
        .when(kind == "secret", _whole(m, key, 16, "secret")).when(kind == "date", _date(m, key))
        .when(kind == "ssn", _whole(m, key, 10, "ssn")).when(kind == "ipv4", _ipv4(m, key)).when(kind == "card", _card(m, key)), m)


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id, text, n_found, found`` for every row of ``docs(doc_id, text)``.

    ``text`` has each validated value replaced by its pseudonym; ``found`` lists kind and pseudonym in
    text order.  Null texts stay null and have none; repeated rows and null ids are treated like any
    other; other columns are ignored.
    """
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"))
    # a value has a digit or an @: the long pattern runs on such texts only
    rows = rows.withColumn("raw", F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))))
    one = lambda m: F.struct(kind_of(m).alias("kind"), m.alias("value"))
    rows = rows.withColumn("raw", F.transform("raw", one))
    new = lambda x: F.struct(x["kind"].alias("kind"), pseudonym(x["value"], x["kind"], key).alias("value"))
    rows = rows.withColumn("new", F.transform("raw", new))
    parts = F.split("text", PATTERN, -1)
    joined = F.array_join(F.flatten(F.zip_with(parts, "new", lambda p, x: F.array(p, F.coalesce(x["value"], F.lit(""))))), "")
    found = F.filter(F.coalesce("new", F.array().cast("array<struct<kind:string,value:string>>")), lambda x: x["kind"].isNotNull())
    return rows.select("doc_id", F.when(F.size("new") > 0, joined).otherwise(F.col("text")).alias("text"),
                       F.size(found).cast("long").alias("n_found"), found.alias("found"))


def op3_pii(spark, sf_dir: str) -> DataFrame:
    return pseudonymize(spark.read.parquet(f"{sf_dir}/documents.parquet"), key="buyerlens-demo-key")
