"""Personal data: format-preserving Feistel pseudonyms, by SQL functions alone.

Found and validated: card numbers (13 to 19 digits, Luhn), IBANs (modulo 97), calendar dates of 1900 to
2099, US social security numbers, phone numbers, IPv4 addresses, e-mail addresses and hexadecimal
secrets of 32 digits or more. A value is permuted under a key within its own format: a keyed Feistel
network runs over its digits (or its day number, or its address), check digits are made anew, and marks
and spaces stay where they were. The network is a permutation, so equal values get equal pseudonyms in
all documents and different ones different pseudonyms. A social security number that falls on one that can't be valid is
permuted on until it is. E-mail names and secrets, which have no fixed alphabet, get a keyed digest (of 80 bits
at least): equal values get equal ones, and two different values share one by chance of that size only. What fails validation is left as it is, but never hides what
is valid: card numbers and IBANs are looked for from each edge of a word to each edge within their longest length
(the longest valid card number; the IBAN of its country's length, else the longest valid one), and the text is
then cut at these very values. A phone number of three, three and four digits among other digits is found too.

An address has 256 characters before the @, labels of 63 and 127 labels at most. Null and empty texts stay as they are;
texts of any length are rewritten whole, at a cost that grows with the square of the card numbers in one text; equal rows give equal
results; an empty table gives an empty one; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns, first fit first. Each starts and ends at the edge of a word. All repetitions of groups are bounded
#: (the JVM's expressions recurse once for each), as are those that a place may be the start of again and again.
KINDS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,255}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,63}",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "secret": r"(?:[0-9a-f]{32,}|[0-9A-F]{32,})",
    "ip": r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}",
    "date": r"(?:(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])[./](?:0[1-9]|1[0-2])[./](?:19|20)[0-9]{2})",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}|\+[0-9]{8,14}",
}
EDGE, END = r"(?<![A-Za-z0-9_+])", r"(?![A-Za-z0-9_])"
#: What begins at the edge of a word and may hold a card number or an IBAN.
CARD_FROM = EDGE + r"(?=([0-9](?:[ -]?[0-9]){12,18})" + END + r")[0-9]+"
IBAN_FROM = EDGE + rf"(?=({KINDS['iban']})" + END + r")[A-Z]{2}"
#: Lengths of IBANs, by country.
LENGTHS = "NO15 BE16 BI16 DK18 FK18 FO18 FI18 GL18 NL18 SD18 MK19 SI19 AT20 BA20 EE20 KZ20 LT20 LU20 MN20 XK20 CR22 CH21 HR21 LI21 LV21 BG22 BH22 DE22 GB22 GE22 IE22 ME22 RS22 VA22 AE23 GI23 IL23 IQ23 OM23 SO23 TL23 AD24 CZ24 ES24 MD24 PK24 RO24 SA24 SE24 SK24 TN24 VG24 CV25 LY25 AO25 GW25 MZ25 PT25 ST25 IR26 DZ26 IS26 TR26 BI27 CF27 CG27 CM27 DJ27 FR27 GA27 GQ27 GR27 IT27 KM27 MC27 MG27 MR27 SM27 TD27 AL28 AZ28 BF28 BJ28 BY28 CI28 CY28 DO28 GT28 HN28 HU28 LB28 MA28 ML28 NE28 NI28 PL28 SN28 SV28 TG28 BR29 EG29 PS29 QA29 UA29 JO30 KW30 MU30 YE30 MT31 SC31 LC32 RU33".split()
OF_COUNTRY = "^(?:" + "|".join(f"{x[:2]}.{{{int(x[2:]) - 2}}}" for x in LENGTHS) + ")$"
#: Cheap to look for, and in every match: a secret of letters alone has 32 of them in a row.
HINT = r"[0-9]{3}|[0-9][ ./-][0-9]|@|[A-Z]{2}[0-9]{2}|[0-9a-f]{32}|[0-9A-F]{32}"
ROUNDS = 8


def _keyed(key: str, tweak: Column, part: Column, round_no: Column) -> Column:
    """A round's pseudo-random number, under 2**60."""
    seed = F.concat_ws("|", F.lit(key), tweak, round_no.cast("string"), part.cast("string"))
    return F.conv(F.substring(F.sha2(seed, 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, tweak: Column, left: Column, right: Column, a: Column, b: Column, finish: Callable[[Column, Column], Column]) -> Column:
    """Permute (left, right) in Z_a x Z_b, then ``finish`` it: even rounds add a keyed number to left, odd ones to right.

    The rounds are one fold over their numbers: nested expressions would be analysed again at each level.
    """

    def step(s: Column, k: Column) -> Column:
        even = k % 2 == 0
        other = F.when(even, s["r"]).otherwise(s["l"])
        add = _keyed(key, tweak, other, k)
        return F.struct(
            F.when(even, F.pmod(s["l"] + F.pmod(add, a), a)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(add, b), b)).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: finish(s["l"], s["r"]))


def permuted_digits(key: str, tweak: Column, digits: Column) -> Column:
    """Digits permuted among those of equal length (2 to 36 digits)."""
    size = F.length(digits)
    half = F.floor(size / 2).cast("int")
    low = F.substr(digits, F.lit(1), half)
    high = F.substr(digits, half + 1, size - half)
    a, b = F.pow(F.lit(10.0), half).cast("long"), F.pow(F.lit(10.0), size - half).cast("long")
    return feistel(key, F.concat(tweak, size.cast("string")), low, high, a, b, lambda l, r: F.concat(F.lpad(l.cast("string"), half, "0"), F.lpad(r.cast("string"), size - half, "0")))


def refilled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in order by ``digits``."""

    def at(i: Column) -> Column:
        c = F.substr(form, i, F.lit(1))
        n = F.length(F.regexp_replace(F.substr(form, F.lit(1), i), "[^0-9]", ""))
        return F.when(c.rlike("[0-9]"), F.substr(digits, n, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), at), "")


def luhn_digit(body: Column) -> Column:
    """The digit that makes ``body`` followed by it pass Luhn's test."""
    size = F.length(body)

    def value(i: Column) -> Column:
        d = F.substr(body, i, F.lit(1)).cast("int")
        doubled = F.when(d >= 5, d * 2 - 9).otherwise(d * 2)
        return F.when((size - i) % 2 == 0, doubled).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), size), value), F.lit(0), lambda acc, x: acc + x)
    return ((10 - total % 10) % 10).cast("string")


def mod97(text: Column) -> Column:
    """ISO 7064 remainder of letters and digits, A as 10 up to Z as 35."""
    code = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: F.when(c < 10, (acc * 10 + c) % 97).otherwise((acc * 100 + c) % 97)
    return F.aggregate(F.transform(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1))), code), F.lit(0), step)


def _date(key: str, v: Column) -> Column:
    """A day of 1900 to 2099 as another: 73000 days are Z_250 x Z_292, the last 49 are Z_7 x Z_7."""
    iso = F.substr(v, F.lit(5), F.lit(1)) == "-"
    sep = F.substr(v, F.lit(3), F.lit(1))
    text = F.when(iso, v).otherwise(F.concat_ws("-", F.substr(v, F.lit(7), F.lit(4)), F.substr(v, F.lit(4), F.lit(2)), F.substr(v, F.lit(1), F.lit(2))))
    day = F.datediff(F.try_to_date(text, "yyyy-MM-dd"), F.lit("1900-01-01").cast("date"))
    tail = day >= 73000
    a, b = F.when(tail, F.lit(7)).otherwise(F.lit(250)).cast("long"), F.when(tail, F.lit(7)).otherwise(F.lit(292)).cast("long")
    n = F.when(tail, day - 73000).otherwise(day)

    def shown(l: Column, r: Column) -> Column:
        new = F.date_add(F.lit("1900-01-01").cast("date"), (l * b + r + F.when(tail, F.lit(73000)).otherwise(F.lit(0))).cast("int"))
        return F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(new, "dd"), sep, F.date_format(new, "MM"), sep, F.date_format(new, "yyyy")))

    tweak = F.when(tail, F.lit("date-tail")).otherwise(F.lit("date"))
    return F.when(day.isNotNull(), feistel(key, tweak, F.floor(n / b), n % b, a, b, shown))


def _ip(key: str, v: Column) -> Column:
    octets = F.transform(F.split(v, r"\."), lambda x: x.cast("long"))
    shown = lambda l, r: F.concat_ws(".", *[x.cast("string") for x in (F.floor(l / 256), l % 256, F.floor(r / 256), r % 256)])
    return feistel(key, F.lit("ip"), octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(65536), F.lit(65536), shown)


def _card(key: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    new = permuted_digits(key, F.lit("card"), body)
    valid = luhn_digit(body) == F.substr(digits, F.length(digits), F.lit(1))
    return F.when(valid, refilled(v, F.concat(new, luhn_digit(new))))


def _iban(key: str, v: Column) -> Column:
    """The country and letters stay; the account's digits are permuted and the check digits made anew."""
    flat = F.regexp_replace(v, " ", "")
    country, account = F.substr(flat, F.lit(1), F.lit(2)), F.substr(flat, F.lit(5), F.length(flat))
    digits = F.regexp_replace(account, "[^0-9]", "")
    new = refilled(account, permuted_digits(key, F.concat(F.lit("iban"), country), digits))
    check = F.lpad((98 - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    shown = F.concat(country, refilled(F.substr(v, F.lit(3), F.length(v)), F.concat(check, F.regexp_replace(new, "[^0-9]", ""))))
    valid = (mod97(F.concat(account, country, F.substr(flat, F.lit(3), F.lit(2)))) == 1) & (F.length(digits) >= 2) & (F.length(digits) <= 30)
    return F.when(valid, shown)


def _phone(key: str, v: Column) -> Column:
    """The last seven digits are permuted; country and area stay."""
    digits = F.regexp_replace(v, "[^0-9]", "")
    keep = F.length(digits) - 7
    new = F.concat(F.substr(digits, F.lit(1), keep), permuted_digits(key, F.concat(F.lit("phone"), F.substr(digits, F.lit(1), keep)), F.substr(digits, keep + 1, F.lit(7))))
    return F.when((F.length(digits) >= 8) & (F.length(digits) <= 15), refilled(v, new))


def _ssn(key: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "-", "")
    bad = lambda d: d.rlike("^(000|666|9)|^...00|0000$")
    once = lambda d: permuted_digits(key, F.lit("ssn"), d)
    # one in nine is not valid, so 40 steps are never used up
    new = F.aggregate(F.sequence(F.lit(1), F.lit(40)), once(digits), lambda d, _: F.when(bad(d), once(d)).otherwise(d))
    return F.when(~bad(digits), refilled(v, new))


def _email(key: str, v: Column) -> Column:
    """Case doesn't tell addresses apart; the name's length stays (20 to 40 digits), the domain is reserved."""
    name = F.substring_index(v, "@", 1)
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(v)), 256)
    return F.concat(F.lit("u"), F.substr(digest, F.lit(1), F.greatest(F.least(F.length(name), F.lit(40)), F.lit(20))), F.lit("@example.invalid"))


def _secret(key: str, v: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), F.lower(v)), 256)
    new = F.substr(F.repeat(digest, F.ceil(F.length(v) / 64).cast("int")), F.lit(1), F.length(v))
    return F.when(v.rlike("[A-F]"), F.upper(new)).otherwise(new)


def _whole(kind: str, v: Column) -> Column:
    return v.rlike(f"^(?:{KINDS[kind]})$")


def pseudonym(key: str, v: Column) -> Column:
    """A letter for the kind (``-`` where no validation passes) followed by the new text of one match."""
    make = {"email": _email, "iban": _iban, "secret": _secret, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}
    tried = [F.when(_whole(kind, v), F.concat(F.lit(chr(97 + n)), make[kind](key, v))) for n, kind in enumerate(KINDS)]
    return F.coalesce(*tried, F.concat(F.lit("-"), v))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _valid_parts(text: Column, begins: str, least: int, valid: Callable[[Column], Column], first: Callable[[Column], Column] | None = None) -> Column:
    """The valid value at each place where one may begin: of those that end at the edge of a word the longest, or one that is ``first``."""

    def best(v: Column) -> Column:
        size = F.length(v)
        cut = F.filter(F.sequence(size, F.least(F.lit(least), size), F.lit(-1)), lambda n: F.substr(v, n, F.lit(2)).rlike("^[A-Z0-9](?:[ -]|$)"))
        fits = F.filter(F.transform(cut, lambda n: F.substr(v, F.lit(1), n)), valid)
        return _let(fits, lambda fits: F.coalesce(F.get(F.filter(fits, first), F.lit(0)), F.get(fits, F.lit(0)))) if first else F.get(fits, F.lit(0))

    return F.filter(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(begins), F.lit(1))), best), lambda v: v.isNotNull())


def _is_card(v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    size = F.length(digits)
    return F.when((size >= 13) & (size <= 19), luhn_digit(F.substr(digits, F.lit(1), size - 1)) == F.substr(digits, size, F.lit(1))).otherwise(False)


def _is_iban(v: Column) -> Column:
    flat = F.regexp_replace(v, " ", "")
    size = F.length(F.regexp_replace(F.substr(flat, F.lit(5), F.length(flat)), "[^0-9]", ""))
    return F.when(_whole("iban", v) & (size >= 2) & (size <= 30), mod97(F.concat(F.substr(flat, F.lit(5), F.length(flat)), F.substr(flat, F.lit(1), F.lit(4)))) == 1).otherwise(False)


def _pattern(text: Column) -> Column:
    """What to cut the text at: its own valid IBANs and card numbers, longer ones first, then the other kinds, then what only looks like one."""
    ibans = _valid_parts(text, IBAN_FROM, 12, _is_iban, lambda v: F.regexp_replace(v, " ", "").rlike(OF_COUNTRY))
    cards = _valid_parts(text, CARD_FROM, 13, _is_card)
    own = F.array_join(F.sort_array(F.array_distinct(F.concat(ibans, cards)), asc=False), "|")
    known = _let(own, lambda own: F.when(own == "", F.lit("(?!)")).otherwise(F.concat(F.lit("(?:"), own, F.lit(")" + END))))
    return _let(known, _cut_at)


def _cut_at(known: Column) -> Column:
    """The pattern of a text with its own known values."""
    # what fails is passed over whole, up to what is valid
    no = F.concat(F.lit("(?!" + EDGE), known, F.lit(")"))
    iban = F.concat(F.lit("[A-Z]{2}[0-9]{2}(?: ?"), no, F.lit("[A-Z0-9]{4}){2,7}(?: ?"), no, F.lit("[A-Z0-9]{1,3})?"))
    card = F.concat(F.lit("[0-9](?:[ -]?"), no, F.lit("(?!" + EDGE + "[0-9]{3}[ -][0-9]{3}[ -][0-9]{4}" + END + ")[0-9]){12,18}"))
    rest = [F.lit(KINDS[k]) for k in ("secret", "ip", "date", "ssn")]
    tried = [F.lit(KINDS["email"]), known, iban, *rest, F.lit("[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}"), card, F.lit(KINDS["phone"])]
    return F.concat(F.lit(EDGE + "(?:"), F.concat_ws("|", *tried), F.lit(")" + END))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", prefix: str = "n_") -> DataFrame:
    """``docs`` with ``text`` rewritten and a count column for each kind: n_email, n_iban and so on.

    Whoever knows the key can undo the numbers. Where ``docs`` has such a column, all counts get one more underscore before.
    """
    while any(c.lower() == f"{prefix}{kind}" for c in docs.columns for kind in KINDS):
        prefix = "_" + prefix
    # where no card number or IBAN may begin, the pattern is the same in all texts
    plain = EDGE + "(?:" + "|".join(KINDS.values()) + ")" + END
    pattern = F.when(F.col(text).rlike(f"{CARD_FROM}|{IBAN_FROM}"), _pattern(F.col(text))).otherwise(F.lit(plain))
    marked = docs.withColumn("__cut", F.when(F.col(text).rlike(HINT), pattern))
    found = F.transform(F.regexp_extract_all(F.col(text), F.col("__cut"), F.lit(0)), lambda v: pseudonym(key, v))
    named = marked.withColumn("__found", found)
    ends = F.concat(F.transform("__found", lambda x: F.substr(x, F.lit(2))), F.array(F.lit("")))
    new = F.when(F.size("__found") > 0, F.array_join(F.zip_with(F.split(F.col(text), F.col("__cut"), -1), ends, lambda x, y: F.concat(x, y)), "")).otherwise(F.col(text))
    kinds = F.transform("__found", lambda x: F.substr(x, F.lit(1), F.lit(1)))
    out = named.withColumn("__kinds", kinds).withColumn(text, new)

    def count(n: int) -> Column:
        letter = F.lit(chr(97 + n))
        return F.when(F.col("__kinds").isNull(), 0).otherwise(F.size(F.filter("__kinds", lambda x: x == letter))).cast("int")

    counts = {f"{prefix}{kind}": count(n) for n, kind in enumerate(KINDS)}
    return out.withColumns(counts).drop("__cut", "__found", "__kinds")
